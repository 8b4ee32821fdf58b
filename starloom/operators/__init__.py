"""Relational operators of the warehouse, marts and feature tables."""
