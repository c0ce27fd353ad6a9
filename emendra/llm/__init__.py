"""Training-data operators: extraction, tokenizing, deduplication, scanning, scoring and formatting.

Nothing else in the library imports this subpackage.
"""
