"""Daily revenue forecast (F1-F6, A14 on the forecast).

An additive model in the spirit of Taylor & Letham (2018): piecewise-linear
trend (hinges at changepoints in the first 80% of the history), weekly and
yearly Fourier seasonality, and the daily order count as an extra
regressor.  The hinges carry an L1 penalty, so that the trend bends at few of them, the other
terms a small L2 penalty; one aggregation of the day series gives the Gram matrix, and
coordinate descent on it the coefficients.
The heavy work -- fact rows to one row per day -- is the distributed
aggregation of ``marts.daily_sales``; the fit then runs on the day series,
which is bounded by the calendar (366 rows a year).

Interval bounds are quantiles of a seeded simulation, one row per future day and
draw: the trend goes on bending as often as the history has changepoints, by
Laplace-distributed steps as large as the history's on average, and noise is normal with the
residuals' deviation.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_date_text
from ..operators import marts, series
from ..session import ensure_checkpoint_dir

WEEKLY_ORDER = 3
YEARLY_ORDER = 10
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
INTERVAL = 0.8
HINGE_L1 = 0.002         # on standardised hinges and values
TERM_L2 = 0.001
DRAWS = 1000
SEED = 42
HOLDOUT_DAYS = 30


@dataclass
class Forecaster:
    coef: dict                  # term -> coefficient
    intercept: float
    start: str
    end: str
    span_days: float
    knots: list
    noise: float                # standard deviation of the residuals
    trend_cols: list
    weekly_cols: list
    yearly_cols: list
    regressor_cols: list

    @property
    def step(self) -> float:
        """Mean size of the history's slope changes."""
        hinges = [abs(self.coef[c]) for c in self.trend_cols[1:]]
        return sum(hinges) / len(hinges) if hinges else 0.0


def _features(df: DataFrame, start: str, span: float, knots: list) -> tuple[DataFrame, list, list, list, list]:
    t = F.datediff(F.col("ds"), F.to_date(F.lit(start))).cast("double") / F.lit(span)
    cols = [t.alias("t")]
    trend = ["t"]
    for i, k in enumerate(knots):
        cols.append(F.greatest(t - F.lit(k), F.lit(0.0)).alias(f"cp{i}"))
        trend.append(f"cp{i}")
    dayno = F.datediff(F.col("ds"), F.to_date(F.lit("1970-01-01"))).cast("double")
    weekly, yearly = [], []
    for n in range(1, WEEKLY_ORDER + 1):
        a = 2 * math.pi * n * dayno / 7.0
        cols += [F.sin(a).alias(f"w_sin{n}"), F.cos(a).alias(f"w_cos{n}")]
        weekly += [f"w_sin{n}", f"w_cos{n}"]
    for n in range(1, YEARLY_ORDER + 1):
        a = 2 * math.pi * n * dayno / 365.25
        cols += [F.sin(a).alias(f"y_sin{n}"), F.cos(a).alias(f"y_cos{n}")]
        yearly += [f"y_sin{n}", f"y_cos{n}"]
    out = df.select("*", *cols)
    return out, trend, weekly, yearly, ["total_orders"]


def day_series(wh) -> DataFrame:
    """Delivered revenue and orders per day, stored: one scan of the fact for
    everything a forecast needs.  A calendar, whatever the order volume."""
    ensure_checkpoint_dir(wh.dates.sparkSession)
    return marts.daily_sales(wh).checkpoint(eager=True)


def training_series(days: DataFrame) -> DataFrame:
    """``day_series`` with incomplete boundary days removed."""
    return series.trim_boundary_days(days).select(
        "ds", F.col("revenue").cast("double").alias("y"), F.col("total_orders").cast("double").alias("total_orders")
    ).where(F.col("y").isNotNull())


def gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Products of every two of (1, ``cols``), summed over the rows: each task sums
    its own, the driver the tasks' matrices."""
    def products(batches):
        total = np.zeros((len(cols) + 1, len(cols) + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["total"])

    rows = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(products, "total binary").collect()
    return sum((pickle.loads(r["total"]) for r in rows), np.zeros((len(cols) + 1, len(cols) + 1)))


def coordinate_descent(g: np.ndarray, l1: np.ndarray, l2: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) that minimise, over standardised columns and values,
    half the mean squared error plus ``l1`` |b| plus half ``l2`` b^2.  ``g`` holds the
    products of (1, columns, value)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    still = scale <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(still, 1.0, scale)
    cor = cov / np.outer(scale, scale)
    q, r = cor[:-1, :-1], cor[:-1, -1]
    b = np.zeros(len(r))
    for _ in range(rounds):
        largest = 0.0
        for j in np.flatnonzero(~still[:-1]).tolist():
            pull = r[j] - q[j] @ b + q[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / (q[j, j] + l2[j])
            largest, b[j] = max(largest, abs(new - b[j])), new
        if largest < tolerance:
            break
    coef = b * scale[-1] / scale[:-1]
    return coef, float(mean[-1] - coef @ mean[:-1])


def _value(coef: dict, cols: list[str]):
    return sum((F.col(c) * F.lit(coef[c]) for c in cols), F.lit(0.0))


def fit(history: DataFrame) -> Forecaster:
    span = history.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).first()
    start, days = str(span["lo"]), max((span["hi"] - span["lo"]).days, 1)
    knots = [CHANGEPOINT_RANGE * (i + 1) / (CHANGEPOINTS + 1) for i in range(CHANGEPOINTS)]
    feats, trend, weekly, yearly, reg = _features(history, start, float(days), knots)
    inputs = trend + weekly + yearly + reg
    hinge = np.array([c.startswith("cp") for c in inputs])
    products = gram(feats, [*inputs, "y"])
    found, intercept = coordinate_descent(products, np.where(hinge, HINGE_L1, 0.0), np.where(hinge, 0.0, TERM_L2))
    weights = np.array([intercept, *found, -1.0])
    noise = math.sqrt(max(float(weights @ products @ weights), 0.0) / products[0, 0])
    return Forecaster(dict(zip(inputs, found.tolist())), intercept, start, str(span["hi"]), float(days), knots, noise, trend, weekly, yearly, reg)


def _uniform(*parts) -> F.Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def simulated_bounds(fc: Forecaster, ds: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(ds, low, high): quantiles of (simulated value - yhat) for every day of
    ``ds``; up to the end of the history the noise is all there is."""
    spark, tail = ds.sparkSession, (1 - INTERVAL) / 2
    ahead = F.datediff("ds", F.to_date(F.lit(fc.end)))
    horizon = max(ds.agg(F.max(ahead)).first()[0] or 0, 0)
    # as many changepoints a day as the history has
    rate = CHANGEPOINTS / (CHANGEPOINT_RANGE * fc.span_days)
    days = spark.range(draws).withColumnRenamed("id", "draw").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    u = _uniform("draw", "day", F.lit("size"))
    laplace = F.when(u < 0.5, F.log(2 * u)).otherwise(-F.log(2 * (1 - u))) * fc.step
    bend = F.when((F.col("day") > 0) & (_uniform("draw", "day", F.lit("when")) < rate), laplace).otherwise(0.0)
    # a slope that changes on a day works from the next day on; both sums run over one draw's days
    so_far = Window.partitionBy("draw").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    slope = days.withColumn("bend", bend).withColumn("slope", F.coalesce(F.sum("bend").over(so_far), F.lit(0.0)))
    drift = F.sum("slope").over(Window.partitionBy("draw").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) / fc.span_days
    normal = F.sqrt(-2 * F.log(_uniform("draw", "day", F.lit("r")))) * F.cos(2 * math.pi * _uniform("draw", "day", F.lit("a")))
    off = slope.select("day", (drift + normal * fc.noise).alias("off"))
    bounds = off.groupBy("day").agg(F.percentile("off", tail).alias("low"), F.percentile("off", 1 - tail).alias("high"))
    # one row per future day
    return ds.select("ds").distinct().withColumn("day", F.greatest(ahead, F.lit(0))).join(F.broadcast(bounds), "day").select(
        "ds", F.least("low", F.lit(0.0)).alias("low"), F.greatest("high", F.lit(0.0)).alias("high"))


def predict(fc: Forecaster, frame: DataFrame) -> DataFrame:
    """yhat with interval bounds and the per-component contributions."""
    feats, trend, weekly, yearly, reg = _features(frame, fc.start, fc.span_days, fc.knots)
    yhat = _value(fc.coef, trend + weekly + yearly + reg) + F.lit(fc.intercept)
    out = feats.withColumn("yhat", yhat).join(simulated_bounds(fc, frame.select("ds")), "ds", "left")
    return out.select(
        *frame.columns, "yhat",
        (F.col("yhat") + F.col("low")).alias("yhat_lower"),
        (F.col("yhat") + F.col("high")).alias("yhat_upper"),
        (_value(fc.coef, trend) + F.lit(fc.intercept)).alias("trend"),
        _value(fc.coef, weekly).alias("weekly"), _value(fc.coef, yearly).alias("yearly"), _value(fc.coef, reg).alias("extra_regressors"))


def forecast(wh, days: int = 30) -> DataFrame:
    """The next ``days`` days: ds (text), yhat, yhat_lower, yhat_upper."""
    daily = day_series(wh)
    fc = fit(training_series(daily))
    future = series.future_regressor(daily.select("ds", "total_orders"), days).where(F.col("is_future"))
    pred = predict(fc, future.select("ds", "total_orders"))
    return pred.select(iso_date_text("ds").alias("ds"), "yhat", "yhat_lower", "yhat_upper").orderBy("ds")


def components(wh) -> DataFrame:
    history = training_series(day_series(wh))
    fc = fit(history)
    return predict(fc, history).select("ds", "y", "yhat", "trend", "weekly", "yearly", "extra_regressors").orderBy("ds")


def holdout_error(wh, days: int = HOLDOUT_DAYS) -> DataFrame:
    """MAE / RMSE / MAPE / R^2 of the model on the last ``days`` days,
    fitted on the days before them."""
    history = training_series(day_series(wh))
    last = history.agg(F.max("ds")).first()[0]
    cut = F.date_sub(F.lit(last), days)
    fc = fit(history.where(F.col("ds") <= cut))
    test = predict(fc, history.where(F.col("ds") > cut))
    return series.forecast_error(test.select("y", "yhat"))


def summary(fc_rows: DataFrame) -> DataFrame:
    """Total, mean, peak and peak day of a forecast (earliest day on a tie)."""
    return fc_rows.agg(
        F.round(F.sum("yhat"), 2).alias("total_revenue"),
        F.round(F.avg("yhat"), 2).alias("daily_average"),
        F.min_by("ds", F.struct((-F.col("yhat")).alias("n"), F.col("ds"))).alias("peak_day"),
        F.round(F.max("yhat"), 2).alias("peak_revenue"))
