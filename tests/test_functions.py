"""Scalar helpers: floor days, calendar attributes, parsing, text cleaning."""

import datetime as dt

from pyspark.sql import functions as F

from starloom.functions.calendar import date_attributes, floor_days, parse_timestamp
from starloom.functions.text import clean_sql_text


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_floor_days_traps(spark):
    rows = [(ts("2020-01-02 01:00:00"), ts("2020-01-01 23:00:00"), -1),
            (ts("2020-01-01 23:00:00"), ts("2020-01-02 01:00:00"), 0),
            (ts("2020-01-01 00:00:00"), ts("2020-01-03 00:00:00"), 2),
            (ts("2020-01-01 12:00:00"), None, None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want int")
    got = df.select(floor_days("a", "b").alias("d"), "want").collect()
    assert [r.d for r in got] == [r.want for r in got]


def test_delay_is_difference_of_floors(spark):
    df = spark.createDataFrame([(ts("2020-01-01 12:00:00"), ts("2020-01-02 11:00:00"), ts("2020-01-02 13:00:00"))],
                               "p timestamp_ntz, d timestamp_ntz, e timestamp_ntz")
    r = df.select((floor_days("p", "d") - floor_days("p", "e")).alias("delay")).first()
    assert r.delay == -1


def test_iso_week_53_and_weekend(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2021, 1, 4),)], "d date")
    r = df.select(*date_attributes("d")).collect()
    assert (r[0].week_of_year, r[0].day_of_week, r[0].is_weekend) == (53, "Sunday", True)
    assert (r[1].week_of_year, r[1].day_of_week, r[1].is_weekend) == (1, "Monday", False)
    assert r[0].month_name == "January" and r[0].quarter == 1


def test_bad_timestamp_is_null(spark):
    df = spark.createDataFrame([("junk",), ("2017-10-02 10:56:33",)], "s string")
    got = [r.t for r in df.select(parse_timestamp("s").alias("t")).collect()]
    assert got[0] is None and got[1] is not None


def test_clean_sql_text(spark):
    df = spark.createDataFrame([("```sql\nSELECT 1\n```",), ("  SELECT 2 \n",), ("```SELECT 3```",)], "t string")
    got = [r.c for r in df.select(clean_sql_text("t").alias("c")).collect()]
    assert got == ["SELECT 1", "SELECT 2", "SELECT 3"]
