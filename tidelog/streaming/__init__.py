"""Incremental solving over streams of facts."""
