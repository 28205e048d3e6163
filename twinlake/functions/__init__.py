"""Column expressions: canonical text, row hashes, slices, buckets, identifiers and literals."""
