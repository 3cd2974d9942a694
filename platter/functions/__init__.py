"""Column expressions and keyed lookups."""
