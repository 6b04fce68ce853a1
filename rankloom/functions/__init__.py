"""Column-level building blocks: scalars, array vectors, keyed randomness."""
