"""Raw marketplace CSV files -> the nine raw sources.

Every file is read with its header and no type inference (all strings,
one cheap pass for the header only); the columns the warehouse uses are
then selected by name and cast explicitly.  Unparsable timestamps become
NULL instead of failing; ZIP prefixes stay text, so leading zeros survive.
A UTF-8 byte-order mark in front of the header is dropped by the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import parse_timestamp
from ..session import path_bytes
from .quoted import read_quoted
from .raw import MONEY, RawTables

# File names of the marketplace dataset.
FILES = {
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "categories": "product_category_name_translation.csv",
    "orders": "olist_orders_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
}


# Review comments are free text: quoted fields may hold line breaks, so records
# are found by the parity of quotes (``quoted``), in many tasks a file like the others.
MULTI_LINE = frozenset({"reviews"})


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header-named string columns; malformed lines are kept (PERMISSIVE)."""
    plain = (spark.read.option("header", True).option("inferSchema", False)
             .option("mode", "PERMISSIVE").option("escape", '"').csv(path))
    return read_quoted(spark, path, [c.lstrip("\ufeff") for c in plain.columns]) if multi_line else plain


def _strip_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def raw_from_csv(spark: SparkSession, folder: str) -> RawTables:
    t = {name: _strip_bom(read_csv(spark, f"{folder.rstrip('/')}/{f}", name in MULTI_LINE)) for name, f in FILES.items()}
    customers = t["customers"].select("customer_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    sellers = t["sellers"].select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    products = t["products"].select(
        "product_id", "product_category_name",
        *[F.col(c).try_cast("double").alias(c) for c in
          ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")])
    categories = t["categories"].select("product_category_name", "product_category_name_english")
    orders = t["orders"].select(
        "order_id", "customer_id", "order_status",
        *[parse_timestamp(c).alias(c) for c in
          ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")])
    items = t["items"].select(
        "order_id", "product_id", "seller_id",
        F.col("price").try_cast("decimal(10,2)").cast(MONEY).alias("price"),
        F.col("freight_value").try_cast("decimal(10,2)").cast(MONEY).alias("freight_value"))
    payments = t["payments"].select(
        "order_id",
        F.struct(F.col("payment_sequential").try_cast("int").alias("payment_sequential")).alias("payment_sequence"),
        "payment_type",
        F.col("payment_installments").try_cast("int").alias("payment_installments"),
        F.col("payment_value").try_cast("decimal(10,2)").cast(MONEY).alias("payment_value"))
    reviews = t["reviews"].select("order_id", F.col("review_score").try_cast("int").alias("review_score"))
    geolocation = t["geolocation"].select(
        "geolocation_zip_code_prefix", "geolocation_city", "geolocation_state",
        F.col("geolocation_lat").try_cast("double").alias("geolocation_lat"),
        F.col("geolocation_lng").try_cast("double").alias("geolocation_lng"))

    def bound(name):
        # a row of n fields takes n bytes at least (separators and line end):
        # a proven bound from the file's size alone, without parsing it
        return lambda: path_bytes(spark, f"{folder.rstrip('/')}/{FILES[name]}") // len(t[name].columns) + 1

    bounds = {name: bound(name) for name in FILES}
    return RawTables(customers, sellers, products, categories, orders, items, payments, reviews,
                     geolocation, bounds)


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows, malformed rows (wrong field count) and parsed characters of one
    CSV file: a PERMISSIVE read with a ``_corrupt_record`` column.  The
    character total keeps every field referenced, so every field is parsed
    (Spark refuses a query on the corrupt-record column alone)."""
    from pyspark.sql.types import StringType, StructField, StructType
    header = [c.lstrip("\ufeff") for c in read_csv(spark, path, multi_line).columns]
    if multi_line:
        df = read_quoted(spark, path, header, "_corrupt_record")
    else:
        schema = StructType([StructField(c, StringType()) for c in header]
                            + [StructField("_corrupt_record", StringType())])
        df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").option("escape", '"').csv(path))
    chars = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in header]))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed_rows"),
                  F.sum(chars).alias("field_chars"))
