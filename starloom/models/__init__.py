"""Data-parallel models: customer segments, review
classifier, daily revenue forecast."""
