"""Column functions: text parsing, canonical hashes, projections and civil time."""
