"""Column expressions: names, geometry, classes and vectors."""
