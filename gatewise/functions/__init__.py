"""Column expressions and small Arrow UDFs."""
