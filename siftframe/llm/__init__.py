"""Operators for preparing training text: deduplication, tokens, archives, classifiers, extraction."""
