"""Operators for large collections of texts and records; nothing outside this package imports it."""
