"""Column expressions and DataFrame operators; every operator is lazy."""
