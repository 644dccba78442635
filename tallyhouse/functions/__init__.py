"""Column functions: predicates, day buckets, arrays and scalar values."""
