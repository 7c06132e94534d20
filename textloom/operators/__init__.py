"""DataFrame-to-DataFrame operators. Order is semantic: every one that picks a first or a last row takes it by an explicit order."""
