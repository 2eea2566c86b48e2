"""Files that arrive."""
