"""Raw marketplace sources derived from the driver's TPC-H-like tables.

The warehouse builders consume nine raw sources (customers, sellers,
products, category dictionary, orders, order items, payments, reviews,
geolocation) with the column names of the original marketplace CSV files.
Here each source is a lazy projection of the driver tables following the
derivation rules in FIXTURES.md part B; nothing is random, so the DuckDB
oracle can rebuild the same rows.  ``sources.csv`` reads the same shapes from
CSV files instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table, row_count

MONEY = "decimal(18,2)"

# The category dictionary of the test fixture (FIXTURES.md B).
# 'standard' is absent on purpose, so its English name stays NULL.
CATEGORY_DICTIONARY = [
    ("economy", "value_line"),
    ("large", "large_goods"),
    ("medium", "medium_goods"),
    ("promo", "promotions"),
    ("small", "small_goods"),
]

# Fixture code mappings (FIXTURES.md B).
ORDER_STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
PAYMENT_TYPE = {"A": "credit_card", "N": "boleto", "R": "voucher"}


def _map_codes(col: Column, mapping: dict) -> Column:
    expr = None
    for code, name in mapping.items():
        expr = (F.when(col == code, name) if expr is None else expr.when(col == code, name))
    return expr


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def to_money(col: Column) -> Column:
    """Money enters as decimal(10,2) (the warehouse's NUMERIC(10,2)) and is
    widened to decimal(18,2) so per-order sums cannot overflow."""
    return col.cast("decimal(10,2)").cast(MONEY)


@dataclass
class RawTables:
    """The nine raw sources plus proven row-count bounds for size checks."""

    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    categories: DataFrame
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    geolocation: DataFrame
    bounds: dict = field(default_factory=dict)
    spans: dict = field(default_factory=dict, repr=False)   # shared by parts of the same tables (``replace``)

    def payment_spans(self, find):
        """``find`` over the payments, looked up once for all parts of these tables."""
        if "payments" not in self.spans:
            self.spans["payments"] = find(self.payments)
        return self.spans["payments"]

    def bound(self, name: str) -> int:
        """Upper bound on the rows of raw source ``name`` (and of anything
        grouped or deduplicated from it)."""
        value = self.bounds[name]
        return value() if callable(value) else value


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


def orders_from_table(o: DataFrame) -> DataFrame:
    """Driver ``orders`` rows -> raw marketplace orders (works on a batch or
    a streaming micro-batch alike)."""
    key = F.col("o_orderkey")
    delivered_ok = (F.col("o_orderstatus") == "F") & (key % 50 != 0)
    return o.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _map_codes(F.col("o_orderstatus"), ORDER_STATUS).alias("order_status"),
        (F.col("o_orderdate") + hours(key * 7 % 24)).alias("order_purchase_timestamp"),
        F.when(delivered_ok, F.col("o_orderdate") + days(key % 37) + hours(key * 5 % 24))
         .alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + days(10 + key % 20)).alias("order_estimated_delivery_date"),
    )


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows at every scale factor: a fixed-size dictionary.
    return F.broadcast(read_table(spark, sf_dir, "nation", "n_nationkey", "n_name"))


def raw_from_testdata(spark: SparkSession, sf_dir: str) -> RawTables:
    nation = _nation(spark, sf_dir)

    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    cust = cust.join(nation, cust.c_nationkey == nation.n_nationkey)
    customers = cust.select(
        F.col("c_custkey").alias("customer_id"),
        F.lpad((F.col("c_custkey") % 1000).cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )
    geolocation = cust.select(
        F.lpad((F.col("c_custkey") % 50).cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
        (F.col("c_acctbal") / 1000).alias("geolocation_lat"),
        (F.col("c_nationkey") - F.col("c_acctbal") / 500).alias("geolocation_lng"),
    )

    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    supp = supp.join(nation, supp.s_nationkey == nation.n_nationkey)
    sellers = supp.select(
        F.col("s_suppkey").alias("seller_id"),
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.concat(F.lit("CITY_"), (F.col("s_suppkey") % 10).cast("string")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )

    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.lower("p_type")).alias("product_category_name"),
        (F.col("p_size") * 100.0).alias("product_weight_g"),
        (F.col("p_size") + 1.0).alias("product_length_cm"),
        (F.col("p_size") / 2.0).alias("product_height_cm"),
        (F.col("p_size") + 3.0).alias("product_width_cm"),
    )
    categories = spark.createDataFrame(
        CATEGORY_DICTIONARY, "product_category_name string, product_category_name_english string")

    orders = orders_from_table(read_table(spark, sf_dir, "orders", *ORDER_COLUMNS))

    li = read_table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    items = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.cast(MONEY).alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(10,2)").cast(MONEY).alias("freight_value"),
    )
    # "first" payment of an order = lowest (line, part, supplier, ...) tuple:
    # whole lineitem rows are unique, (order, line) alone is not.
    payments = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.struct(*[F.col(c) for c in PAYMENT_SEQUENCE]).alias("payment_sequence"),
        _map_codes(F.col("l_returnflag"), PAYMENT_TYPE).alias("payment_type"),
        (1 + F.col("l_quantity").cast("int") % 10).alias("payment_installments"),
        price.cast(MONEY).alias("payment_value"),
    )
    reviews = (li.where((F.col("l_orderkey") % 10 != 0) & (F.col("l_linenumber") <= 2))
                 .select(F.col("l_orderkey").alias("order_id"),
                         (1 + (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 5).cast("int").alias("review_score")))

    def counter(name):
        cache = {}

        def get():
            if name not in cache:
                cache[name] = row_count(spark, sf_dir, name)
            return cache[name]
        return get

    bounds = {
        "customers": counter("customer"), "geolocation": counter("customer"),
        "sellers": counter("supplier"), "products": counter("part"),
        "categories": len(CATEGORY_DICTIONARY), "orders": counter("orders"),
        "items": counter("lineitem"), "payments": counter("lineitem"), "reviews": counter("lineitem"),
    }
    return RawTables(customers, sellers, products, categories, orders, items, payments,
                     reviews, geolocation, bounds)


# Order of the lineitem columns that defines the "first" payment of an order.
PAYMENT_SEQUENCE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
