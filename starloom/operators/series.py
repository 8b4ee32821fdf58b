"""Daily series operators for the revenue forecast (W4, W5, U2, P8, F1,
F3, F5, A14).

The series have one row per calendar day, so they are bounded by the
length of the history (366 rows a year) whatever the order volume; the
heavy part -- fact rows to days -- is the distributed aggregation in
``marts.daily_sales`` / ``marts.daily_orders``.  Windows with a global
order over a day series are therefore single small tasks by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_date_text

TRAILING_ROWS = 14
HORIZON_DAYS = 30
TRIM_FRACTION_DENOMINATOR = 10  # boundary days under 1/10 of the median day are dropped


def trailing_mean(daily: DataFrame, col: str = "total_orders", rows: int = TRAILING_ROWS) -> DataFrame:
    """Rolling mean over the last ``rows`` rows (current row included)."""
    w = Window.orderBy("ds").rowsBetween(-(rows - 1), 0)
    return daily.select("ds", col, F.avg(col).over(w).alias(f"trailing_{rows}"))


def _last_rows_mean(daily: DataFrame, col: str, rows: int) -> DataFrame:
    """One row: mean of ``col`` over the last ``rows`` days of history."""
    return daily.orderBy(F.col("ds").desc()).limit(rows).agg(F.avg(col).alias("fill"))


def last_rows_mean(daily: DataFrame, col: str = "total_orders", rows: int = TRAILING_ROWS) -> float | None:
    """Mean of ``col`` over the last ``rows`` days of history: one scalar."""
    return _last_rows_mean(daily, col, rows).first()[0]


def future_calendar(daily: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    """History days followed by the next ``days`` calendar days."""
    last = daily.agg(F.max("ds").alias("m"))
    future = last.select(F.explode(F.sequence(F.date_add("m", 1), F.date_add("m", days))).alias("ds"))
    return (daily.select("ds", F.lit(False).alias("is_future"))
                 .unionByName(future.select("ds", F.lit(True).alias("is_future"))))


def future_regressor(daily: DataFrame, days: int = HORIZON_DAYS, rows: int = TRAILING_ROWS) -> DataFrame:
    """Calendar joined to known order counts, in date order; unknown (future)
    days get the mean of the last ``rows`` history rows."""
    fill = F.broadcast(_last_rows_mean(daily, "total_orders", rows))  # one row
    known = daily.select("ds", "total_orders")
    return (future_calendar(daily, days).join(known, "ds", "left").join(fill, F.lit(True), "left")
            .select("ds", "is_future", F.coalesce(F.col("total_orders").cast("double"), F.col("fill")).alias("total_orders"))
            .orderBy("ds"))


def trim_boundary_days(daily: DataFrame, col: str = "total_orders",
                       denominator: int = TRIM_FRACTION_DENOMINATOR) -> DataFrame:
    """Drop leading and trailing days whose ``col`` is under 1/denominator of
    the median day (incomplete data at the edges of the history)."""
    med = daily.agg(F.median(col).alias("med"))
    ok = daily.join(F.broadcast(med), F.col(col) * denominator >= F.col("med"), "left_semi")  # one-row side
    span = ok.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return daily.join(F.broadcast(span), (F.col("ds") >= F.col("lo")) & (F.col("ds") <= F.col("hi")), "left_semi")


def lag_forecast(daily: DataFrame, col: str = "revenue", lag_days: int = 7) -> DataFrame:
    """Naive seasonal forecast: the value of the same weekday a week earlier."""
    prev = daily.select(F.date_add("ds", lag_days).alias("ds"), F.col(col).alias("yhat"))
    return daily.select("ds", F.col(col).alias("y")).join(prev, "ds")


def forecast_error(pairs: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE (days with y = 0 skipped) and R^2 over (y, yhat)
    rows.  Errors and squares are summed as exact decimals, then divided."""
    p = pairs.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).select(
        F.col("y").cast("decimal(18,2)").alias("y"), F.col("yhat").cast("decimal(18,2)").alias("yhat"))
    e = F.col("y") - F.col("yhat")
    g = p.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("sae"), F.sum(e * e).alias("sse"),
              F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
              F.sum(F.when(F.col("y") != 0, F.abs(e).cast("double") / F.col("y").cast("double"))).alias("sape"),
              F.count_if(F.col("y") != 0).alias("n_ape"))
    n = F.col("n").cast("double")
    sst = F.col("syy").cast("double") - F.col("sy").cast("double") * F.col("sy").cast("double") / n
    return g.select(
        "n", (F.col("sae").cast("double") / n).alias("mae"),
        F.sqrt(F.col("sse").cast("double") / n).alias("rmse"),
        F.round(F.col("sape") / F.col("n_ape"), 9).alias("mape"),
        (1 - F.col("sse").cast("double") / sst).alias("r2"))


def window_summary(series: DataFrame, value: str, days: int = HORIZON_DAYS) -> DataFrame:
    """Total, daily mean, peak value and peak day (earliest on a tie) over
    the last ``days`` days of a daily series."""
    last = series.agg(F.max("ds").alias("m"))
    recent = series.join(F.broadcast(last), F.col("ds") > F.date_sub("m", days), "left_semi")
    v = F.col(value)
    return recent.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(v).alias("total"),
        (F.sum(v).cast("double") / F.count(v)).alias("daily_average"),
        F.max(v).alias("peak"),
        F.min_by("ds", F.struct((-v).alias("neg"), F.col("ds"))).alias("_peak_day"),
    ).select("days", "total", "daily_average", "peak", iso_date_text("_peak_day").alias("peak_day"))
