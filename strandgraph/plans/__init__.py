"""Named queries over the fixed tables, and the same in SQL."""
