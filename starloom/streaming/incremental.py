"""Incremental loading with Structured Streaming (S4 as micro-batches).

New order files are a file stream; each micro-batch of orders goes through the
warehouse load with its items, payments and reviews, so new customers, products
and days get keys and stored ones keep theirs.  A load replaces its own orders,
so a micro-batch replayed after a failure adds nothing: the result is
exactly-once; progress lives in the checkpoint location.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fact import FACT_COLUMNS
from ..operators.joins import BROADCAST_ROW_LIMIT
from ..sources.raw import ORDER_COLUMNS, RawTables, orders_from_table


def order_file_stream(spark: SparkSession, folder: str, pattern: str = "orders*.parquet",
                      files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{pattern}").select(*ORDER_COLUMNS).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder).select(*ORDER_COLUMNS))


def batch_tables(raw: RawTables, orders: DataFrame, n_orders: int, limit: int | None = None) -> RawTables:
    """The raw tables for a batch of ``n_orders`` orders.  A small batch's ids are
    broadcast, and only its items, payments and reviews reach the rollups.  For a
    large batch the tables stay whole: the fact joins them to the batch's orders anyway, and
    rolled up they are smaller in that join's shuffles than the rows of a semi-join."""
    limit = BROADCAST_ROW_LIMIT if limit is None else limit
    if n_orders > limit:
        return replace(raw, orders=orders)
    ids = F.broadcast(orders.select("order_id"))
    return replace(raw, orders=orders, **{t: getattr(raw, t).join(ids, "order_id", "left_semi") for t in ("items", "payments", "reviews")})


def start_fact_stream(stream: DataFrame, wh, out_dir: str, checkpoint: str, available_now: bool = True):
    """Start the loader into the warehouse folder ``out_dir``; ``wh`` supplies
    the raw tables beside orders."""

    def load(batch: DataFrame, batch_id: int) -> None:
        from ..plans.warehouse import Warehouse, write_warehouse
        batch = batch.persist()
        orders = orders_from_table(batch)
        write_warehouse(Warehouse(batch_tables(wh.raw, orders, batch.count())), out_dir)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_loaded(spark: SparkSession, out_dir: str) -> DataFrame:
    from ..plans.warehouse import read_warehouse
    return read_warehouse(spark, out_dir.rstrip("/")).fact.select(*FACT_COLUMNS)


def load_orders_incrementally(spark: SparkSession, wh, folder: str, out_dir: str, checkpoint: str,
                              pattern: str = "orders*.parquet") -> DataFrame:
    """Run the loader over every order file present now and return the
    loaded fact rows."""
    q = start_fact_stream(order_file_stream(spark, folder, pattern), wh, out_dir, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_loaded(spark, out_dir)
