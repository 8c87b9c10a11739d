"""Column expressions and SQL twins of the scalar functions."""
