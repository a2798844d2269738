"""Operators for preparing training text: counting, cleaning, deduplicating, packing, storing."""
