"""Column expressions and Arrow functions on single lines."""
