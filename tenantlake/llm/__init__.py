"""Operators that prepare training text: filters, duplicates, formats, models."""
