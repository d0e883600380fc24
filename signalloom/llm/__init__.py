"""Operators for preparing training text at scale: extraction, filtering, deduplication, mixing, packing."""
