"""Streaming execution of the row-local corpus chain (no new operators)."""
