"""Named queries over the operators, and their equivalents in SQL."""
