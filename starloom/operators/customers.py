"""Customer behaviour features.

One ``groupBy(customer_id)`` over delivered, delivered-on-record, reviewed
fact rows.  Money averages are exact sum / count.  The two distinct counts
are planned by Catalyst as one Expand + partial aggregation; everything
combines map-side, so a customer holding a third of all rows is reduced in
every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import floor_days
from ..functions.money import ratio_plus_one
from .joins import lookup_side

# The ten clustering inputs, in the model's order.
SEGMENT_FEATURES = [
    "total_spent", "avg_order_value", "avg_freight", "avg_delivery_days",
    "avg_review_score", "avg_delay", "total_installments", "unique_categories",
    "price_per_day", "freight_ratio",
]
# The spend columns that are logged.
LOG_FEATURES = ["total_spent", "avg_order_value", "price_per_day"]


def customer_features(wh, min_orders: int = 1, with_dates: bool = True) -> DataFrame:
    f = wh.fact.where((F.col("order_status") == "delivered")
                      & F.col("days_to_deliver").isNotNull()
                      & F.col("review_score").isNotNull())
    p = lookup_side(wh.products.select("product_key", "category_name_english"), wh.bound("products"))
    j = f.join(p, "product_key")
    aggs = [
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("price").alias("_spent"), F.count("price").alias("_n_price"),
        F.sum("freight_value").alias("_freight"), F.count("freight_value").alias("_n_freight"),
        F.avg("days_to_deliver").alias("avg_delivery_days"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg("delivery_delay_days").alias("avg_delay"),
        F.sum("payment_installments").cast("long").alias("total_installments"),
        F.countDistinct("category_name_english").alias("unique_categories"),
    ]
    if with_dates:
        aggs += [F.max("order_purchase_timestamp").alias("last_purchase"),
                 F.min("order_purchase_timestamp").alias("first_purchase")]
    # aggregate per surrogate key first; the customer dimension then joins
    # one row per customer rather than one per fact row
    g = j.groupBy("customer_key").agg(*aggs).where(F.col("total_orders") >= min_orders)
    c = lookup_side(wh.customers.select("customer_key", "customer_id"), wh.bound("customers"))
    g = g.join(c, "customer_key")
    spent = F.col("_spent").cast("double")
    aov = spent / F.col("_n_price")
    avg_freight = F.col("_freight").cast("double") / F.col("_n_freight")
    out = g.select(
        "customer_id", "total_orders",
        spent.alias("total_spent"), aov.alias("avg_order_value"), avg_freight.alias("avg_freight"),
        "avg_delivery_days", "avg_review_score", "avg_delay", "total_installments", "unique_categories",
        *(["last_purchase", "first_purchase"] if with_dates else []))
    return out.select(
        *out.columns,
        ratio_plus_one("total_spent", "avg_delivery_days").alias("price_per_day"),
        ratio_plus_one("avg_freight", "avg_order_value").alias("freight_ratio"))


def customer_rfm(feats: DataFrame) -> DataFrame:
    """Recency (days before the latest purchase of anyone) and lifetime
    (first to last purchase), both in floor days.  The global latest
    purchase is a one-row aggregate of the same plan."""
    latest = F.broadcast(feats.agg(F.max("last_purchase").alias("_latest")))  # one row
    return feats.join(latest, F.lit(True), "left").select(
        "customer_id", "last_purchase", "first_purchase",
        floor_days(F.col("last_purchase"), F.col("_latest")).alias("recency"),
        floor_days("first_purchase", "last_purchase").alias("customer_lifetime_days"))


def log_spend(feats: DataFrame, cols: list[str] = LOG_FEATURES) -> DataFrame:
    """``log1p`` of the spend columns (the serving-side transform)."""
    return feats.select(*[F.log1p(c).alias(c) if c in cols else F.col(c) for c in feats.columns])


def _filled(feats: DataFrame, cols: list[str], keep) -> DataFrame:
    return feats.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def fit_scaler(feats: DataFrame, cols: list[str] = SEGMENT_FEATURES) -> dict[str, tuple[float, float]]:
    """{column: (mean, population standard deviation)} after filling NULLs with
    0; a constant column gets deviation 1.  One aggregate row."""
    row = _filled(feats, cols, []).agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                       *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def apply_scaler(feats: DataFrame, params: dict[str, tuple[float, float]], keep=("customer_id",)) -> DataFrame:
    """Z-scores under fitted parameters, for the fitted rows or new ones."""
    return _filled(feats, list(params), keep).select(
        *keep, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in params.items()])


def standardize(feats: DataFrame, cols: list[str] = SEGMENT_FEATURES, keep=("customer_id",)):
    """Z-scores of ``feats`` in one plan (its one-row aggregate is joined, not
    fetched); see ``fit_scaler`` for the rules."""
    filled = _filled(feats, cols, keep)
    stats = F.broadcast(filled.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                   *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in cols]))
    return filled.join(stats, F.lit(True), "left").select(
        *keep, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in cols])
