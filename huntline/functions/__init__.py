"""Column functions: predicates, scalars, paths, addresses, call stacks, fields."""
