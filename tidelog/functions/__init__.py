"""Rule macros and graph functions."""
