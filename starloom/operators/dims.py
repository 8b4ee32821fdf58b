"""Dimension builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import date_attributes
from ..sources.raw import RawTables
from .dedupe import keep_first
from .joins import lookup_side
from .keys import with_surrogate_key


COORD = "decimal(38,12)"


def dim_customers(raw: RawTables) -> DataFrame:
    df = raw.customers.select(
        "customer_id", "customer_city", "customer_state",
        F.col("customer_zip_code_prefix").alias("customer_zip_code"))
    df = keep_first(df, ["customer_id"])
    return with_surrogate_key(df, "customer_key", ["customer_id"], raw.bound("customers"))


def dim_sellers(raw: RawTables) -> DataFrame:
    df = raw.sellers.select(
        "seller_id", "seller_city", "seller_state",
        F.col("seller_zip_code_prefix").alias("seller_zip_code"))
    df = keep_first(df, ["seller_id"])
    return with_surrogate_key(df, "seller_key", ["seller_id"], raw.bound("sellers"))


def dim_products(raw: RawTables) -> DataFrame:
    """Products with the English category name; a category missing from the
    dictionary gets a NULL English name."""
    tr = keep_first(raw.categories, ["product_category_name"])
    tr = lookup_side(tr, raw.bound("categories"))
    df = raw.products.join(tr, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("category_name"),
        F.col("product_category_name_english").alias("category_name_english"),
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    df = keep_first(df, ["product_id"])
    return with_surrogate_key(df, "product_key", ["product_id"], raw.bound("products"))


def dim_date(raw: RawTables) -> DataFrame:
    """Every calendar date on which an order was placed or delivered."""
    o = raw.orders
    dates = (o.select(F.to_date("order_purchase_timestamp").alias("full_date"))
              .union(o.select(F.to_date("order_delivered_customer_date").alias("full_date")))
              .where(F.col("full_date").isNotNull())
              .distinct())
    # A calendar: at most 366 rows per year of history, so the one-task
    # numbering window is bounded whatever the order volume.
    keyed = with_surrogate_key(dates, "date_key", ["full_date"], row_bound=0)
    return keyed.select("date_key", "full_date", *date_attributes("full_date"))


def dim_geolocation(raw: RawTables) -> DataFrame:
    """Mean coordinates per (zip, city, state); rows with a NULL key part are
    dropped, as a group-by over them would.  Coordinates are summed as
    decimal(38,12) (exact, order-free) and divided once, so the mean does not
    depend on how rows are partitioned."""
    g = raw.geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_code"),
        F.col("geolocation_city").alias("city"),
        F.col("geolocation_state").alias("state"),
        F.col("geolocation_lat").alias("latitude"),
        F.col("geolocation_lng").alias("longitude"))
    keys = ["zip_code", "city", "state"]
    def mean(c):
        return (F.sum(F.col(c).cast(COORD)).cast("double") / F.count(c)).alias(c)
    g = g.dropna(subset=keys).groupBy(*keys).agg(mean("latitude"), mean("longitude"))
    return with_surrogate_key(g, "geo_key", keys, raw.bound("geolocation"))
