"""Column functions: NULL rules, months, parsing, classification."""
