"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it
    back: it cuts lineage, survives lost executors, and lets later steps read
    single columns."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialised tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder.startswith("file:") or "://" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps: it acts when the
    driver collects their dead plans, which a driver with room to spare puts off."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables (Spark's cleaner removes it)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
