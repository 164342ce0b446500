"""Column expressions: text rules, token arrays and vector arithmetic."""
