"""Operators that prepare training text: filters, near-duplicate search, mixing, tokenizers."""
