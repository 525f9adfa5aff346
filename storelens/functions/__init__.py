"""Column expressions and small statistical building blocks."""
