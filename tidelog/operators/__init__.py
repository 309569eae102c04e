"""Relations, and joins, extensions and filters for hand-written fixpoints."""
