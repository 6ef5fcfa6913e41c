"""Operators that prepare training data: text, links, tokens, near duplicates, packing."""
