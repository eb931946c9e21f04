"""DataFrame-to-DataFrame building blocks. None of them runs an action."""
