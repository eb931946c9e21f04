"""The driver's named queries over the star schema, and their SQL counterparts."""
