"""Column expressions: rules, cleaning, hashing."""
