"""Operators for preparing training text: tokens, filters, duplicates, scans, pages."""
