"""Session construction and cluster-level settings.

The library never creates a session on its own inside transforms; callers
(tests, bench, the driver) hand one in.  ``build_session`` is the helper used
by tests and ``bench.py``.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  AQE re-plans joins with
# runtime sizes (broadcast switch beyond our own checks), coalesces small
# shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "starloom", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("STARLOOM_MASTER", "local[*]")
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("STARLOOM_DRIVER_MEMORY", "16g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only a local-mode session without one (tests, bench) gets a fresh
    private scratch folder; a cluster session without one is an error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for cluster runs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="starloom-ckpt-"))
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps: it acts when the
    driver collects their dead plans, which a driver with room to spare puts off."""
    gc.collect()
    spark._jvm.System.gc()


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the file or folder ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


ROWS_PER_PARTITION = 200_000


def sized(df, row_bound: int, rows_per_partition: int = ROWS_PER_PARTITION):
    """Spread ``df`` evenly over about ``row_bound / rows_per_partition``
    partitions, one per core at least.  Iterative fits scan their cached input
    many times: hundreds of nearly empty partitions would cost a task each per
    iteration, fewer than the cores would leave some idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-int(row_bound) // rows_per_partition)))
