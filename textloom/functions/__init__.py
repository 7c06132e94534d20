"""Column-to-column functions over text."""
