"""Column-returning helpers: NULL rules, dates and keys, recodes, curves."""
