"""Column functions: normalisation, masks, digits, predicates on proposed values."""
