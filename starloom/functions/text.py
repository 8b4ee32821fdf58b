"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markdown fences removed from generated SQL, in the order
# they are removed.
SQL_FENCES = ("```sql", "```")

# ASCII whitespace as stripped by Python's str.strip on ASCII text.
_WS = "[ \\t\\n\\r\\f\\x0B]"


def strip_ws(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, f"^{_WS}+|{_WS}+$", "")


def clean_sql_text(col: Column | str) -> Column:
    """Remove markdown code fences and surrounding blanks from model output."""
    col = F.col(col) if isinstance(col, str) else col
    for fence in SQL_FENCES:
        col = F.replace(col, F.lit(fence), F.lit(""))
    return strip_ws(col)
