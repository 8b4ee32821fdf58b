"""Micro-batch fact loader: equals the batch fact, and a restart with the
same checkpoint loads nothing twice (exactly-once)."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF0001


def test_stream_loader_exactly_once(spark):
    from starloom.plans.warehouse import warehouse_from_testdata
    from starloom.streaming.incremental import load_orders_incrementally
    src = tempfile.mkdtemp(prefix="starloom-stream-src-")
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    # two arrivals: even and odd order keys, as two files
    orders.where(F.col("o_orderkey") % 2 == 0).coalesce(1).write.parquet(f"{src}/part0")
    orders.where(F.col("o_orderkey") % 2 == 1).coalesce(1).write.parquet(f"{src}/part1")
    folder = tempfile.mkdtemp(prefix="starloom-stream-in-")
    import glob
    import shutil
    for i, d in enumerate(("part0", "part1")):
        f = glob.glob(f"{src}/{d}/*.parquet")[0]
        shutil.copy(f, f"{folder}/orders-{i}.parquet")
    wh = warehouse_from_testdata(spark, SF0001)
    base = tempfile.mkdtemp(prefix="starloom-stream-out-")
    out = load_orders_incrementally(spark, wh, folder, f"{base}/out", f"{base}/state", pattern="orders-*.parquet")
    n1 = out.count()
    assert n1 == wh.fact.count()
    assert out.select("order_id").distinct().count() == orders.count()
    again = load_orders_incrementally(spark, wh, folder, f"{base}/out", f"{base}/state", pattern="orders-*.parquet")
    assert again.count() == n1
