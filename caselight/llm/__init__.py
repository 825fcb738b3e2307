"""Operators for preparing training text: counting, cleaning, duplicates, search, scoring and encoding."""
