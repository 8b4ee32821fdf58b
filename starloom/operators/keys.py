"""Surrogate keys: 1..n in the order of a natural key (W1, SERIAL).

Two exact strategies, picked by a proven row bound:

* small (bound <= ``local_limit``): ``row_number`` over a global order, which
  Spark runs in one task -- fine for a calendar or a small dimension;
* large: range-partition on the key, number rows inside each partition,
  and add the row count of all earlier partitions.  The per-partition counts
  are one row per partition, so broadcasting them is bounded by the
  partition count, not by the data.  The numbered rows are checkpointed to
  the reliable checkpoint folder first, so a lost executor cannot renumber
  a partition differently between the count and the assignment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

LOCAL_LIMIT = 200_000


def with_surrogate_key(df: DataFrame, key: str, order: list[str], row_bound: int,
                       local_limit: int | None = None, num_partitions: int | None = None) -> DataFrame:
    local_limit = LOCAL_LIMIT if local_limit is None else local_limit
    if row_bound <= local_limit:
        w = Window.orderBy(*order)
        return df.select(F.row_number().over(w).cast("long").alias(key), *df.columns)
    return _distributed_key(df, key, order, num_partitions or shuffle_partitions(df.sparkSession))


def _distributed_key(df: DataFrame, key: str, order: list[str], num_partitions: int) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(num_partitions, *order)
                .sortWithinPartitions(*order)
                .withColumn("_kp", F.spark_partition_id())
                .withColumn("_ki", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    counts = ranged.groupBy("_kp").agg(F.count(F.lit(1)).alias("_kn"))
    before = Window.orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_kp", F.coalesce(F.sum("_kn").over(before), F.lit(0)).alias("_ko"))
    # one row per partition -> bounded broadcast
    numbered = ranged.join(F.broadcast(offsets), "_kp")
    position = F.col("_ki") - F.shiftleft(F.col("_kp").cast("long"), 33)
    return numbered.select((F.col("_ko") + position + 1).cast("long").alias(key), *df.columns)


def with_stored_keys(df: DataFrame, stored: DataFrame, key: str, natural: list[str], order: list[str],
                     row_bound: int) -> DataFrame:
    """Rows of ``df`` whose natural key is not in ``stored`` yet, numbered on
    from the largest stored key, as a SERIAL would.  Stored rows keep their
    keys, so facts that point to them stay right.  A NULL natural key is one
    key like any other, stored once."""
    known = stored.select(*[F.col(c).alias(f"_stored_{c}") for c in natural])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_stored_{c}")) for c in natural])
    new = df.join(known, same, "left_anti").drop(key)
    last = stored.agg(F.max(key)).first()[0] or 0
    numbered = with_surrogate_key(new, key, order, row_bound)
    return numbered.withColumn(key, F.col(key) + F.lit(last)).select(*stored.columns)
