"""Column expressions and exact order statistics shared by the operators."""
