"""Column functions: each builds a Catalyst expression, none runs Python per row."""
