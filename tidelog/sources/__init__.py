"""Facts from files, and intermediate tables."""
