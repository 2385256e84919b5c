"""Column expressions: text, seeded draws, argument checks."""
