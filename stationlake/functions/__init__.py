"""Column expressions shared by the operators (all built-in functions, no UDF)."""
