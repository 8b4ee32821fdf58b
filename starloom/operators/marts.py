"""Reporting marts over the star schema.

Joins to ``dim_date`` are broadcast (a calendar is bounded); joins to the
product and customer dimensions broadcast only under the proven row bound.
Each mart has one distinct count, which Catalyst plans as a pre-aggregation
on (group, order_id) followed by a count: a hot group is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_sum
from .joins import lookup_side

DELIVERED = "delivered"


def _dates(wh) -> DataFrame:
    return F.broadcast(wh.dates)


def monthly_sales(wh) -> DataFrame:
    """Delivered orders by purchase month (the monthly sales view)."""
    f = wh.fact.where(F.col("order_status") == DELIVERED)
    d = _dates(wh)
    j = f.join(d, f.order_date_key == d.date_key)
    return (j.groupBy("year", "month", "month_name").agg(
                F.countDistinct("order_id").alias("total_orders"),
                money_sum("price").alias("total_revenue"),
                money_sum("freight_value").alias("total_freight"),
                F.avg("review_score").alias("avg_review_score"),
                F.avg("days_to_deliver").alias("avg_delivery_days"))
             .orderBy("year", "month"))


def sales_by_category(wh) -> DataFrame:
    """All statuses, by English category; the NULL category is a group.
    Highest revenue first, NULL revenue ahead of everything (as PostgreSQL)."""
    f = wh.fact
    p = lookup_side(wh.products.select("product_key", "category_name_english"), wh.bound("products"))
    j = f.join(p, "product_key")
    return (j.groupBy(F.col("category_name_english").alias("category")).agg(
                F.countDistinct("order_id").alias("total_orders"),
                money_sum("price").alias("total_revenue"),
                F.avg("review_score").alias("avg_review_score"))
             .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_first()))


def sales_by_state(wh) -> DataFrame:
    """All statuses, by customer state.

    The fact is first aggregated per customer key (an order belongs to one
    customer, so distinct orders and exact sums add up per state), then the
    customer dimension is joined to one row per customer instead of one per
    item: at scale the join no longer ships the fact.
    """
    per_customer = wh.fact.groupBy("customer_key").agg(
        F.countDistinct("order_id").alias("_orders"), F.sum("price").alias("_revenue"),
        F.sum("days_to_deliver").alias("_days"), F.count("days_to_deliver").alias("_n_days"))
    c = lookup_side(wh.customers.select("customer_key", "customer_state"), wh.bound("customers"))
    j = per_customer.join(c, "customer_key")
    return (j.groupBy(F.col("customer_state").alias("state")).agg(
                F.sum("_orders").alias("total_orders"),
                money_sum("_revenue").alias("total_revenue"),
                F.try_divide(F.sum("_days").cast("double"), F.sum("_n_days").cast("double")).alias("avg_delivery_days"))
             .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("state").asc_nulls_first()))


def daily_orders(wh) -> DataFrame:
    """Distinct delivered orders per purchase day (forecast regressor)."""
    f = wh.fact.where(F.col("order_status") == DELIVERED)
    d = _dates(wh)
    j = f.join(d, f.order_date_key == d.date_key)
    return (j.groupBy(F.col("full_date").alias("ds"))
             .agg(F.countDistinct("order_id").alias("total_orders"))
             .orderBy("ds"))


def daily_sales(wh) -> DataFrame:
    """Delivered revenue and distinct orders per purchase day (forecast target)."""
    f = wh.fact.where(F.col("order_status") == DELIVERED)
    d = _dates(wh)
    j = f.join(d, f.order_date_key == d.date_key)
    return (j.groupBy(F.col("full_date").alias("ds"))
             .agg(money_sum("price").alias("revenue"),
                  F.countDistinct("order_id").alias("total_orders"))
             .orderBy("ds"))


def kpi_overview(wh) -> DataFrame:
    """Headline numbers over delivered orders: revenue, orders, mean review."""
    f = wh.fact.where(F.col("order_status") == DELIVERED)
    return f.agg(money_sum("price").alias("total_revenue"),
                 F.countDistinct("order_id").alias("total_orders"),
                 F.avg("review_score").alias("avg_review_score"))


def seasonality_index(wh, by: str) -> DataFrame:
    """Mean daily revenue per weekday or month relative to the mean day:
    ``index = mean(revenue | group) / mean(revenue) - 1``.

    ``by`` is ``"weekday"`` or ``"month"``.  The per-group aggregate has at
    most 12 rows, so the overall mean is a window over that tiny result.
    """
    daily = daily_sales(wh).select("ds", "revenue")
    if by == "weekday":
        keys = [F.date_format("ds", "EEEE").alias("day_of_week"), (F.weekday("ds") + 1).alias("iso_day")]
    elif by == "month":
        keys = [F.month("ds").alias("month"), F.date_format("ds", "MMMM").alias("month_name")]
    else:
        raise ValueError(by)
    g = daily.groupBy(*keys).agg(F.sum("revenue").alias("_s"), F.count("revenue").alias("days"))
    everything = Window.partitionBy()
    s_all, n_all = F.sum("_s").over(everything), F.sum("days").over(everything)
    mean = F.col("_s").cast("double") / F.col("days")
    return g.select(*[k for k in g.columns if k not in ("_s",)],
                    mean.alias("avg_revenue"),
                    (mean / (s_all.cast("double") / n_all) - 1).alias("revenue_index"))


def top_categories(wh, k: int = 5) -> DataFrame:
    """The k categories with the highest revenue (top-k, TakeOrderedAndProject)."""
    return sales_by_category(wh).limit(k)
