"""The load at scale: purchase ranges by whole days, hot keys by groups."""

import datetime as dt

from pyspark.sql import functions as F

import starloom.operators.joins as J
from starloom.plans.warehouse import ROW_ORDER, by_purchase_time, purchase_ranges

T0 = dt.datetime(2020, 1, 1, 10)


def _orders(spark, days):
    rows = [(i, None if d is None else T0 + dt.timedelta(days=d, minutes=i % 600)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "order_id long, order_purchase_timestamp timestamp_ntz")


def test_whole_days_make_up_ranges_in_order(spark):
    orders = _orders(spark, [None] * 3 + [i % 100 for i in range(400)])
    ranges = purchase_ranges(orders, 8)
    fact = orders.crossJoin(spark.range(3)).select("order_id", "order_purchase_timestamp", F.col("id").alias("product_key"), F.lit(1).alias("seller_key"),
                                                   F.lit(2).alias("price"), F.lit(0).alias("freight_value"))
    dealt = by_purchase_time(fact, ranges, 8)
    assert dealt.columns == fact.columns
    # the sample of a range partitioning would run the joins below it once more
    assert "rangepartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()
    rows = dealt.sortWithinPartitions(*ROW_ORDER).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"), "*").collect()
    assert len(rows) == fact.count() and len({r.k for r in rows}) == len(rows)
    times = [r.order_purchase_timestamp for r in sorted(rows, key=lambda r: r.k)]
    assert times[:9] == [None] * 9 and times[9:] == sorted(times[9:])
    sizes = [sum(r.p == p for r in rows) for p in range(8)]
    assert min(sizes) > 100 and max(sizes) < 200


def test_a_busy_day_is_split_by_rows(spark):
    orders = _orders(spark, [1] * 200 + [i % 100 for i in range(400)])
    assert purchase_ranges(orders, 8) is None
    assert purchase_ranges(_orders(spark, [None] * 200 + [i % 100 for i in range(400)]), 8) is None
    assert purchase_ranges(orders.limit(0), 8).count() == 0


def test_hot_keys_are_found_by_groups(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_KEY_ROWS", 50)
    keys = [None] * 20 + [1] * 120 + [2] * 51 + [3] * 50 + [k for k in range(4, 60) for _ in range(3)]
    right = spark.createDataFrame([(k,) for k in keys], "k long")
    for groups in (1, 4, 1 << 16):
        monkeypatch.setattr(J, "KEY_GROUPS", groups)
        assert sorted(map(tuple, J.hot_keys(right, "k", len(keys)).collect())) == [(1, 3), (2, 2)]
        assert J.hot_keys(right.where("k > 2"), "k", len(keys)) is None
    assert J.hot_keys(right, "k", 50) is None
