"""Date and time helpers (inventory D1-D9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def parse_timestamp(col: Column | str, fmt: str | None = None) -> Column:
    """Text -> timestamp; unparsable text becomes NULL instead of failing."""
    col = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)


def floor_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from ``start`` to ``end`` rounded toward minus infinity (D3).

    Matches the day count of a time difference: -2 hours is -1 day, 23:00 ->
    01:00 the next day is 0 days.  Exact integer arithmetic on seconds.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    secs = F.timestamp_diff("SECOND", start, end)
    return ((secs - F.pmod(secs, F.lit(SECONDS_PER_DAY))) / SECONDS_PER_DAY).cast("int")


def date_attributes(d: Column | str) -> list[Column]:
    """The eight calendar attributes of the date dimension."""
    d = F.col(d) if isinstance(d, str) else d
    return [
        F.dayofmonth(d).alias("day"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        F.weekofyear(d).alias("week_of_year"),  # ISO-8601 week
        F.date_format(d, "EEEE").alias("day_of_week"),
        (F.weekday(d) >= 5).alias("is_weekend"),  # weekday: Monday = 0
    ]


def iso_date_text(d: Column | str) -> Column:
    """``%Y-%m-%d`` text of a date."""
    d = F.col(d) if isinstance(d, str) else d
    return F.date_format(d, "yyyy-MM-dd")
