"""Remaining hand-made traps of FIXTURES.md part C."""

import datetime as dt

from pyspark.sql import functions as F

from starloom.operators import series
from starloom.operators.reviews import _flag


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_short_history_mean_over_what_exists(spark):
    df = spark.createDataFrame([(d, v) for d, v in zip(days(5), [1, 2, 3, 4, 10])], "ds date, total_orders long")
    assert series.last_rows_mean(df, "total_orders", 14) == 4.0
    fut = series.future_regressor(df, days=3).where("is_future").collect()
    assert len(fut) == 3 and all(r.total_orders == 4.0 for r in fut)
    assert str(fut[0].ds) == "2020-01-06"


def test_peak_tie_takes_earliest_day(spark):
    df = spark.createDataFrame([(d, v) for d, v in zip(days(4), [5.0, 9.0, 9.0, 1.0])], "ds date, y double")
    r = series.window_summary(df, "y", 30).first()
    assert r.peak_day == "2020-01-02" and r.peak == 9.0 and r.days == 4


def test_label_and_installment_thresholds(spark):
    df = spark.createDataFrame([(3, 3), (4, 4), (None, None)], "score int, inst int")
    r = df.select((F.col("score") >= 4).cast("int").alias("good"),
                  _flag(F.col("inst") > 3).alias("high")).collect()
    assert [(x.good, x.high) for x in r] == [(0, 0), (1, 1), (None, 0)]


def test_trim_drops_only_boundary_days(spark):
    counts = [1, 50, 60, 2, 55, 1]  # median 27.5: edges under 2.75 go, the inner 2 stays
    df = spark.createDataFrame([(d, c) for d, c in zip(days(6), counts)], "ds date, total_orders long")
    kept = [r.total_orders for r in series.trim_boundary_days(df).orderBy("ds").collect()]
    assert kept == [50, 60, 2, 55]
