"""Incremental comparison of arriving rows."""
