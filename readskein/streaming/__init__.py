"""Incremental use of the batch operators on streams."""
