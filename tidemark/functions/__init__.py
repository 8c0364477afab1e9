"""Column-level helpers: dates, predicates and the fixed vocabulary."""
