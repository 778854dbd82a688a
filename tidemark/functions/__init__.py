"""Column expressions; no UDFs."""
