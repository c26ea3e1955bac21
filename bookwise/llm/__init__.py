"""Operators for preparing training data: filters, joins, search, archives, mixing and packing."""
