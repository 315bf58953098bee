"""Column functions: everything here is a plain Spark expression, no Python per row."""
