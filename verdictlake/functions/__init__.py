"""Column expressions and small table functions shared by the operators."""
