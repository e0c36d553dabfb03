"""Column expressions and pandas functions over texts and records."""
