"""Join helpers with explicit size checks and skew-safe one-to-many joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a (narrow) lookup side we accept to ship to every executor.  Two
# or three long/short-string columns: ~50-100 MB at the limit.
BROADCAST_ROW_LIMIT = 2_000_000


def lookup_side(df: DataFrame, row_bound: int, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only when its proven row bound is under the
    limit.  Beyond it the join stays a shuffle join (sort-merge, with AQE's
    runtime broadcast switch and skew split still available)."""
    limit = BROADCAST_ROW_LIMIT if limit is None else limit
    return F.broadcast(df) if row_bound <= limit else df


# A key with more rows than this on the many side is split into salted
# buckets of about this many rows each.
HOT_KEY_ROWS = 1_000_000


# Groups of keys that are counted together before any key is counted alone.
KEY_GROUPS = 1 << 16


def hot_keys(right: DataFrame, key: str, row_bound: int) -> DataFrame | None:
    """Keys with more than ``HOT_KEY_ROWS`` rows and their salts, or None where there
    are none.  Rows are counted per group of keys first (a hash of the key, so at most
    ``KEY_GROUPS`` counts a task): a hot key makes its group hot, and only the keys
    of hot groups are counted one by one."""
    if row_bound <= HOT_KEY_ROWS:
        return None
    group = F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS))
    # at most row_bound / HOT_KEY_ROWS groups
    groups = [r[0] for r in right.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_KEY_ROWS).select("_g").collect()]
    if not groups:
        return None
    per_key = right.where(group.isin(groups)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_KEY_ROWS)
    if per_key.isEmpty():
        return None
    return lookup_side(per_key.select(key, F.ceil(F.col("_n") / HOT_KEY_ROWS).cast("int").alias("_salts")),
                       max(1, row_bound // HOT_KEY_ROWS))


def left_join_expand(left: DataFrame, right: DataFrame, key: str, row_bound: int) -> DataFrame:
    """``left`` LEFT JOIN ``right`` where ``left`` has one row per key and
    ``right`` many (1:N expansion), safe when one key holds a third of all
    rows.

    Without a hot key (more than ``HOT_KEY_ROWS`` rows on the right) this is
    the plain left join, co-partitioned with ``left``; ``hot_keys`` finds out.
    Hot keys, at most ``row_bound / HOT_KEY_ROWS`` of them, are
    joined apart: their right rows are spread over ceil(n / HOT_KEY_ROWS) salts
    by a hash of the whole row and their one left row is repeated per salt, so
    no task gets more than about ``HOT_KEY_ROWS`` rows of a key.
    """
    return expand_with(left, right, key, hot_keys(right, key, row_bound))


def expand_with(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``left_join_expand`` under known hot keys."""
    if hot is None:
        return left.join(right, key, "left")
    cold = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
    lhs = (left.join(hot, key)
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))
    rhs = (right.join(hot, key)
           .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), F.col("_salts")).cast("int"))
           .drop("_salts"))
    return cold.unionByName(lhs.join(rhs, [key, "_salt"]).drop("_salt"))
