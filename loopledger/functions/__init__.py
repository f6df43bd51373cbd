"""Column functions: every detection step as expressions over one row."""
