"""Access to the driver's parquet tables (``<sf_dir>/<name>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; naming the columns keeps the ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a source table.  A bare count over parquet is answered from
    the row-group footers, so this is cheap at any size; it is the proven
    upper bound used before broadcasting anything derived from the table."""
    return spark.read.parquet(table_path(sf_dir, name)).count()
