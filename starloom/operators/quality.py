"""Data-quality checks for constraints Spark does not enforce (Q1-Q3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_side


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Per (name, table, key columns): keys seen more than once and the
    rows beyond the first.  Counting per key combines map-side."""
    out = []
    for name, df, keys in checks:
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        out.append(per_key.agg(
            F.count_if(F.col("n") > 1).cast("long").alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("excess_rows"),
        ).select(F.lit(name).alias("check_name"), "duplicate_keys", "excess_rows"))
    return _union(out)


def null_counts(tables: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """NULLs per column, one scan per table, unpivoted to
    (table_name, column_name, null_count)."""
    out = []
    for table, df, cols in tables:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
        pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
        out.append(counts.select(F.lit(table).alias("table_name"),
                                 F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, null_count)")))
    return _union(out)


def orphan_counts(fact: DataFrame, refs: list[tuple[str, DataFrame, str, int]]) -> DataFrame:
    """Fact rows whose non-NULL foreign key has no dimension row.

    One scan of the fact: every dimension key set is left-joined (broadcast
    under its proven bound) and the misses are counted together.
    """
    f = fact.select(*[fk for fk, _, _, _ in refs])
    flags = []
    for i, (fk, dim, key, bound) in enumerate(refs):
        keys = dim.select(F.col(key).alias(f"_k{i}"), F.lit(True).alias(f"_hit{i}"))
        f = f.join(lookup_side(keys, bound), F.col(fk) == F.col(f"_k{i}"), "left")
        flags.append(F.count_if(F.col(fk).isNotNull() & F.col(f"_hit{i}").isNull()).cast("long").alias(fk))
    counts = f.agg(*flags)
    pairs = ", ".join(f"'{fk}', `{fk}`" for fk, _, _, _ in refs)
    return counts.select(F.expr(f"stack({len(refs)}, {pairs}) AS (foreign_key, orphan_rows)"))
