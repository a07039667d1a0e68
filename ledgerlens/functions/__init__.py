"""Column functions: exact rounding, rates, time arithmetic, literal lookups."""
