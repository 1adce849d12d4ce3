"""Operators for preparing training text: tokenising, cleaning, deduplicating, packing and archiving."""
