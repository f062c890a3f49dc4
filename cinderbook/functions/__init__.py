"""Column expressions: emission factors and derived metrics."""
