"""Operators that prepare training text: near copies, quality, packing, extraction and formatting."""
