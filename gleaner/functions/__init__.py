"""Column-to-column functions; all are built-in expressions."""
