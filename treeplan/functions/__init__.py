"""Column functions: paths, rules, formats."""
