"""Deferred arrays in blocks of the leading dimension."""
