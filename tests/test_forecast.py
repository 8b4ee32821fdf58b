"""Sparse trend and simulated intervals on made series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.models import forecast as FC

START = dt.date(2020, 1, 1)


def series(spark, values, orders=None):
    rows = [(START + dt.timedelta(days=i), float(v), float(10 if orders is None else orders[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ds date, y double, total_orders double")


def test_coordinate_descent_equals_brute_force():
    """Against proximal gradient steps on the rows themselves."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 3
    y = x @ np.array([2.0, 0.0, -1.0, 0.05]) + rng.normal(0, 0.3, 80) + 7
    l1, l2 = np.array([0.0, 0.05, 0.05, 0.3]), np.array([0.01, 0.0, 0.0, 0.0])
    rows = np.column_stack([np.ones(80), x, y])
    coef, intercept = FC.coordinate_descent(rows.T @ rows, l1, l2)
    xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    b, rate = np.zeros(4), 1 / np.linalg.eigvalsh(xs.T @ xs / 80 + np.diag(l2)).max()
    for _ in range(60_000):
        b = b - rate * (xs.T @ (xs @ b - ys) / 80 + l2 * b)
        b = np.sign(b) * np.maximum(np.abs(b) - rate * l1, 0)
    assert np.allclose(coef, b * y.std() / x.std(0), atol=1e-6) and coef[3] == 0
    assert intercept == pytest.approx(y.mean() - coef @ x.mean(0))


def test_gram_over_partitions(spark):
    df = series(spark, [1.5, 2.5, 4.0, 8.0]).repartition(3)
    assert np.allclose(FC.gram(df, ["y"]), [[4, 16], [16, 1.5**2 + 2.5**2 + 16 + 64]])


def test_few_knots_carry_the_trend(spark):
    """A series that bends once, at the tenth possible changepoint."""
    n, at = 1041, FC.CHANGEPOINT_RANGE * 10 / (FC.CHANGEPOINTS + 1)
    t = np.arange(n) / (n - 1)
    rng = np.random.default_rng(1)
    values = 100 + 50 * t + 400 * np.maximum(t - at, 0) + 10 * np.sin(2 * math.pi * np.arange(n) / 7) + rng.normal(0, 3, n)
    fc = FC.fit(series(spark, values))
    bends = {c: fc.coef[c] for c in fc.trend_cols[1:]}
    near = sum(abs(bends[f"cp{i}"]) for i in (8, 9, 10))
    assert near > 0.85 * sum(map(abs, bends.values())) and sum(v != 0 for v in bends.values()) <= 10
    assert 300 < sum(bends[f"cp{i}"] for i in (8, 9, 10)) < 450


def test_intervals_cover_what_they_say(spark):
    """Without trend changes the noise decides: 80 % of held-out days within 5 points."""
    rng = np.random.default_rng(4)
    n, ahead = 730, 200
    values = 500 + 60 * np.sin(2 * math.pi * np.arange(n + ahead) / 7) + rng.normal(0, 20, n + ahead)
    whole = series(spark, values)
    cut = START + dt.timedelta(days=n)
    fc = FC.fit(whole.where(F.col("ds") < F.lit(cut)))
    rows = FC.predict(fc, whole.where(F.col("ds") >= F.lit(cut))).collect()
    inside = np.mean([r.yhat_lower <= r.y <= r.yhat_upper for r in rows])
    assert len(rows) == ahead and 0.75 <= inside <= 0.88 and abs(fc.noise - 20) < 2


def test_bounds_widen_with_the_trend_s_own_changes(spark):
    days = spark.createDataFrame([(START + dt.timedelta(days=i),) for i in (0, 99, 100, 130, 400)], "ds date")
    fc = FC.Forecaster({"t": 0.0, "cp0": 40.0, "cp1": -40.0}, 0.0, str(START), str(START + dt.timedelta(days=99)), 99.0, [], 1.0, ["t", "cp0", "cp1"], [], [], [])
    b = {r.ds: (r.low, r.high) for r in FC.simulated_bounds(fc, days).collect()}
    width = [b[START + dt.timedelta(days=i)][1] - b[START + dt.timedelta(days=i)][0] for i in (0, 99, 100, 130, 400)]
    assert width[0] == width[1] == pytest.approx(2 * 1.2816, rel=0.15) and width[3] > width[2] and width[4] > 5 * width[3]
    assert all(lo <= 0 <= hi for lo, hi in b.values())
