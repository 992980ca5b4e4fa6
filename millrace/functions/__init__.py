"""Column expressions: text, draws, arrays and code facts."""
