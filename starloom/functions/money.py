"""Exact money arithmetic.

Money is decimal; sums stay decimal (exact, order-independent), averages are
one division of the exact sum by the count, done in double at the end.  This
keeps results identical whatever the partitioning or engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_TOTAL = "decimal(38,2)"


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def money_sum(col: Column | str) -> Column:
    return F.sum(_c(col)).cast(MONEY_TOTAL)


def ratio_plus_one(num: Column | str, den: Column | str) -> Column:
    """``num / (den + 1)``, the guarded ratio of the features; NULL if the
    denominator is exactly zero instead of failing under ANSI mode."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double") + 1)
