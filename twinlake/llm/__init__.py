"""Operators on text corpora. Nothing outside this subpackage imports it."""
