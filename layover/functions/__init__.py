"""Column-level rules: predicates, clocks, text and JSON expressions."""
