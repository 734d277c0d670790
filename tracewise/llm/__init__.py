"""Operators for preparing training text: packing, scans, filters, archives, search."""
