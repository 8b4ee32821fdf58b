"""Registered queries (one per operator of the inventory)."""
