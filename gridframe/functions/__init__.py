"""Column-level helpers and fixed code dictionaries."""
