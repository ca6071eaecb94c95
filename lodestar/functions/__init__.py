"""Column expressions: scalars, normalisers, geometry."""
