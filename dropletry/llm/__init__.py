"""Operators for large text corpora; each module states its contract and its edge cases."""
