"""Column expressions that the operators share."""
