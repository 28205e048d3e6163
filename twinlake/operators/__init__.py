"""Comparison operators as DataFrames: checksums, joins, multisets, sketches, strategies."""
