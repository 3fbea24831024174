"""Column expressions: registry numbers, units, species, routes, ecotoxicity sentences."""
