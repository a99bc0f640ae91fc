"""Operators for preparing training text: scoring, finding, deduplicating, searching, encoding."""
