"""Operators that a large training-data pipeline needs. Nothing else in visret imports this."""
