"""Where tables come from: files, the driver's star schema, saved results."""
