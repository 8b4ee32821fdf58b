"""Structured Streaming form of the warehouse's append sink."""
