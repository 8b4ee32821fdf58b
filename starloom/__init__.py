"""starloom: a Spark-native retail star-schema warehouse, marts and models.

Raw marketplace tables -> dimensions + fact (``operators``) -> marts and
feature tables (``operators``) -> models fitted in shared Spark passes (``models``).
Everything is a lazy DataFrame plan; nothing passes whole through the
driver.
"""

__version__ = "0.1.0"
