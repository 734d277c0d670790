"""Column functions. All are built-in expressions; none runs Python per row."""
