"""Warehouse, data-quality and mart queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.text import clean_sql_text
from ..operators import marts, quality
from ..operators.dedupe import keep_first
from ..operators.fact import payments_per_order, reviews_per_order
from ..plans.adhoc import adhoc_sql, result_sample
from ..plans.catalog import register
from ..plans.oracle import oracle
from ..plans.warehouse import Warehouse, loaded_warehouse, read_warehouse, warehouse_from_testdata, write_warehouse
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table


def _wh(spark, sf_dir):
    """The loaded star schema (built once per session)."""
    return loaded_warehouse(spark, sf_dir)


def _etl(spark, sf_dir):
    """The star schema as a fresh plan over the raw sources."""
    return warehouse_from_testdata(spark, sf_dir)


# The oracles of the marts work from one row per order (or per order and
# product), weighting the per-item means by the items.
_PER_ORDER = """(SELECT order_id, min(order_date_key) AS date_key, min(customer_key) AS customer_key, min(order_status) AS status,
        sum(price) AS price, sum(freight_value) AS freight, count(*) AS items, min(review_score) AS score,
        min(days_to_deliver) AS days
 FROM fact_orders GROUP BY order_id) o"""


def _item_mean(x: str) -> str:
    return f"CAST(sum({x} * items) AS DOUBLE) / CAST(sum(items) FILTER (WHERE {x} IS NOT NULL) AS DOUBLE)"


MONTHLY_SQL = f"""
SELECT year, month, month_name, count(*) AS total_orders, CAST(sum(price) AS DECIMAL(38,2)) AS total_revenue,
       CAST(sum(freight) AS DECIMAL(38,2)) AS total_freight, {_item_mean("score")} AS avg_review_score,
       {_item_mean("days")} AS avg_delivery_days
FROM {_PER_ORDER} JOIN dim_date USING (date_key) WHERE status = 'delivered' GROUP BY ALL"""

CATEGORY_SQL = f"""
SELECT category, count(DISTINCT order_id) AS total_orders, CAST(sum(price) AS DECIMAL(38,2)) AS total_revenue,
       {_item_mean("score")} AS avg_review_score
FROM (SELECT category_name_english AS category, order_id, sum(price) AS price, count(*) AS items, min(review_score) AS score
      FROM dim_products JOIN fact_orders USING (product_key) GROUP BY ALL) GROUP BY category"""

STATE_SQL = f"""
SELECT customer_state AS state, count(*) AS total_orders, CAST(sum(price) AS DECIMAL(38,2)) AS total_revenue,
       {_item_mean("days")} AS avg_delivery_days
FROM dim_customers JOIN {_PER_ORDER} USING (customer_key) GROUP BY customer_state"""

DAILY_SALES_SQL = f"""
SELECT full_date AS ds, CAST(sum(price) AS DECIMAL(38,2)) AS revenue, count(*) AS total_orders
FROM {_PER_ORDER} JOIN dim_date USING (date_key) WHERE status = 'delivered' GROUP BY full_date"""


# ---------------------------------------------------------------- warehouse

@register("dim_customers", oracle("SELECT * FROM dim_customers"))
def q_dim_customers(spark, sf_dir):
    return _etl(spark, sf_dir).customers


@register("dim_sellers", oracle("SELECT * FROM dim_sellers"))
def q_dim_sellers(spark, sf_dir):
    return _etl(spark, sf_dir).sellers


@register("dim_products", oracle("SELECT * FROM dim_products"))
def q_dim_products(spark, sf_dir):
    return _etl(spark, sf_dir).products


@register("dim_date", oracle("SELECT * FROM dim_date ORDER BY full_date"))
def q_dim_date(spark, sf_dir):
    return _etl(spark, sf_dir).dates.orderBy("full_date")


@register("dim_geolocation", oracle("SELECT * FROM dim_geolocation"))
def q_dim_geolocation(spark, sf_dir):
    """Means are exact decimal sums divided once: equal in any engine, unrounded."""
    return _etl(spark, sf_dir).geolocation


@register("payments_per_order", oracle("SELECT * FROM payments_per_order"))
def q_payments_per_order(spark, sf_dir):
    return payments_per_order(_etl(spark, sf_dir).raw)


@register("reviews_per_order", oracle("SELECT * FROM reviews_per_order"))
def q_reviews_per_order(spark, sf_dir):
    return reviews_per_order(_etl(spark, sf_dir).raw)


@register("fact_orders", oracle("SELECT * FROM fact_orders"))
def q_fact_orders(spark, sf_dir):
    return _etl(spark, sf_dir).fact


@register("dedupe_keep_first", oracle("""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
  l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST,
  l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
  l_shipdate NULLS FIRST) = 1"""))
def q_dedupe_keep_first(spark, sf_dir):
    """Keep-first on a key that really repeats: (order, line) of lineitem."""
    li = read_table(spark, sf_dir, "lineitem")
    return keep_first(li, ["l_orderkey", "l_linenumber"]).select(*li.columns)


# ------------------------------------------------------------- data quality

@register("dq_duplicate_keys", oracle("""
SELECT check_name, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_keys,
       CAST(COALESCE(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS excess_rows
FROM (SELECT 'dim_customers.customer_id' AS check_name, count(*) AS n FROM dim_customers GROUP BY customer_id
      UNION ALL SELECT 'dim_customers.customer_key', count(*) FROM dim_customers GROUP BY customer_key
      UNION ALL SELECT 'dim_sellers.seller_id', count(*) FROM dim_sellers GROUP BY seller_id
      UNION ALL SELECT 'dim_sellers.seller_key', count(*) FROM dim_sellers GROUP BY seller_key
      UNION ALL SELECT 'dim_products.product_id', count(*) FROM dim_products GROUP BY product_id
      UNION ALL SELECT 'dim_products.product_key', count(*) FROM dim_products GROUP BY product_key
      UNION ALL SELECT 'dim_date.full_date', count(*) FROM dim_date GROUP BY full_date
      UNION ALL SELECT 'dim_date.date_key', count(*) FROM dim_date GROUP BY date_key
      UNION ALL SELECT 'raw_orders.order_id', count(*) FROM raw_orders GROUP BY order_id)
GROUP BY check_name"""))
def q_dq_duplicate_keys(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    return quality.duplicate_keys([
        ("dim_customers.customer_id", wh.customers, ["customer_id"]),
        ("dim_customers.customer_key", wh.customers, ["customer_key"]),
        ("dim_sellers.seller_id", wh.sellers, ["seller_id"]),
        ("dim_sellers.seller_key", wh.sellers, ["seller_key"]),
        ("dim_products.product_id", wh.products, ["product_id"]),
        ("dim_products.product_key", wh.products, ["product_key"]),
        ("dim_date.full_date", wh.dates, ["full_date"]),
        ("dim_date.date_key", wh.dates, ["date_key"]),
        ("raw_orders.order_id", wh.raw.orders, ["order_id"]),
    ])


_NULL_CHECKS = [
    ("dim_customers", "customers", ["customer_key", "customer_id"]),
    ("dim_sellers", "sellers", ["seller_key", "seller_id"]),
    ("dim_products", "products", ["product_key", "product_id"]),
    ("dim_date", "dates", ["date_key", "full_date"]),
    ("fact_orders", "fact", ["order_id", "customer_key", "seller_key", "product_key",
                             "order_date_key", "delivered_date_key"]),
]


def _null_sql():
    parts = []
    for table, _, cols in _NULL_CHECKS:
        for c in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
                         f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM {table}")
    return "\nUNION ALL ".join(parts)


@register("dq_null_keys", oracle(_null_sql()))
def q_dq_null_keys(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    return quality.null_counts([(t, getattr(wh, attr), cols) for t, attr, cols in _NULL_CHECKS])


@register("dq_orphans", oracle("""
SELECT 'customer_key' AS foreign_key, CAST(count(*) AS BIGINT) AS orphan_rows FROM fact_orders f
  WHERE f.customer_key IS NOT NULL AND f.customer_key NOT IN (SELECT customer_key FROM dim_customers)
UNION ALL SELECT 'seller_key', count(*) FROM fact_orders f
  WHERE f.seller_key IS NOT NULL AND f.seller_key NOT IN (SELECT seller_key FROM dim_sellers)
UNION ALL SELECT 'product_key', count(*) FROM fact_orders f
  WHERE f.product_key IS NOT NULL AND f.product_key NOT IN (SELECT product_key FROM dim_products)
UNION ALL SELECT 'order_date_key', count(*) FROM fact_orders f
  WHERE f.order_date_key IS NOT NULL AND f.order_date_key NOT IN (SELECT date_key FROM dim_date)
UNION ALL SELECT 'delivered_date_key', count(*) FROM fact_orders f
  WHERE f.delivered_date_key IS NOT NULL AND f.delivered_date_key NOT IN (SELECT date_key FROM dim_date)"""))
def q_dq_orphans(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    return quality.orphan_counts(wh.fact, [
        ("customer_key", wh.customers, "customer_key", wh.bound("customers")),
        ("seller_key", wh.sellers, "seller_key", wh.bound("sellers")),
        ("product_key", wh.products, "product_key", wh.bound("products")),
        ("order_date_key", wh.dates, "date_key", 0),
        ("delivered_date_key", wh.dates, "date_key", 0),
    ])


# -------------------------------------------------------------------- marts

@register("monthly_sales", oracle(MONTHLY_SQL + "\nORDER BY year, month"))
def q_monthly_sales(spark, sf_dir):
    return marts.monthly_sales(_wh(spark, sf_dir))


@register("sales_by_category", oracle(CATEGORY_SQL + "\nORDER BY total_revenue DESC NULLS FIRST"))
def q_sales_by_category(spark, sf_dir):
    return marts.sales_by_category(_wh(spark, sf_dir))


@register("sales_by_state", oracle(STATE_SQL + "\nORDER BY total_revenue DESC NULLS FIRST"))
def q_sales_by_state(spark, sf_dir):
    return marts.sales_by_state(_wh(spark, sf_dir))


@register("daily_orders", oracle("""
SELECT CAST(order_purchase_timestamp AS DATE) AS ds, count(*) AS total_orders
FROM orders_level WHERE order_status = 'delivered' AND order_date_key IS NOT NULL
GROUP BY ALL ORDER BY ds"""))
def q_daily_orders(spark, sf_dir):
    return marts.daily_orders(_wh(spark, sf_dir))


@register("daily_sales", oracle(DAILY_SALES_SQL + "\nORDER BY ds"))
def q_daily_sales(spark, sf_dir):
    return marts.daily_sales(_wh(spark, sf_dir))


@register("kpi_overview", oracle("""
SELECT CAST(SUM(price) AS DECIMAL(38,2)) AS total_revenue, COUNT(DISTINCT order_id) AS total_orders,
       AVG(review_score) AS avg_review_score
FROM fact_orders WHERE order_status = 'delivered'"""))
def q_kpi_overview(spark, sf_dir):
    return marts.kpi_overview(_wh(spark, sf_dir))


def _index_sql(keys: str, group: str) -> str:
    return f"""
SELECT {keys}, days, CAST(s AS DOUBLE) / days AS avg_revenue,
       (CAST(s AS DOUBLE) / days) / (CAST(sum(s) OVER () AS DOUBLE) / sum(days) OVER ()) - 1 AS revenue_index
FROM (SELECT {group}, SUM(revenue) AS s, count(revenue) AS days FROM daily GROUP BY ALL)"""


WEEKDAY_CTE = "daily AS (" + DAILY_SALES_SQL + ")"


@register("weekday_index", oracle(
    _index_sql("day_of_week, iso_day", "strftime(ds, '%A') AS day_of_week, CAST(isodow(ds) AS INT) AS iso_day"),
    WEEKDAY_CTE))
def q_weekday_index(spark, sf_dir):
    return marts.seasonality_index(_wh(spark, sf_dir), "weekday")


@register("month_index", oracle(
    _index_sql("month, month_name", "CAST(month(ds) AS INT) AS month, strftime(ds, '%B') AS month_name"),
    WEEKDAY_CTE))
def q_month_index(spark, sf_dir):
    return marts.seasonality_index(_wh(spark, sf_dir), "month")


@register("top_categories", oracle(CATEGORY_SQL + "\nORDER BY total_revenue DESC NULLS FIRST, category NULLS FIRST LIMIT 5"))
def q_top_categories(spark, sf_dir):
    return marts.top_categories(_wh(spark, sf_dir), 5)


# ---------------------------------------------------------- ad-hoc SQL edge

ADHOC_EXAMPLE = "SELECT category, total_revenue FROM vw_sales_by_category ORDER BY total_revenue DESC LIMIT 5"


@register("adhoc_sql_top_categories", oracle(
    "SELECT category, total_revenue FROM vw ORDER BY total_revenue DESC LIMIT 5",
    "vw AS (" + CATEGORY_SQL + ")"))
def q_adhoc_sql_top_categories(spark, sf_dir):
    return adhoc_sql(spark, _wh(spark, sf_dir), ADHOC_EXAMPLE)


@register("result_sample", oracle("""
SELECT year, month, to_json(struct_pack(year := year, month := month, month_name := month_name,
                                        total_orders := total_orders)) AS row_json
FROM (SELECT year, month, month_name, total_orders FROM m ORDER BY year, month LIMIT 20)""",
    "m AS (" + MONTHLY_SQL + ")"))
def q_result_sample(spark, sf_dir):
    m = marts.monthly_sales(_wh(spark, sf_dir)).select("year", "month", "month_name", "total_orders")
    return result_sample(m, 20, keep=["year", "month"])


@register("clean_sql_text", oracle("""
SELECT conv_id, turn,
       regexp_replace(replace(replace(text, '```sql', ''), '```', ''),
                      '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS sql_text
FROM conversations WHERE role = 'assistant'"""))
def q_clean_sql_text(spark, sf_dir):
    """Fence/blank cleaning of model replies, over every assistant turn."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", clean_sql_text("text").alias("sql_text"))


# ---------------------------------------------------------- repeated loads

@register("warehouse_incremental", oracle("""
SELECT f.order_id, c.customer_id, CAST(d.full_date AS VARCHAR) AS order_date, count(*) AS fact_rows, count(*) AS order_keys
FROM fact_orders f LEFT JOIN dim_customers c ON f.customer_key = c.customer_key
LEFT JOIN dim_date d ON f.order_date_key = d.date_key AND f.order_id % 10 <> 3
GROUP BY f.order_id, c.customer_id, d.full_date
UNION ALL SELECT -1, NULL, NULL, count(*), count(*) FROM fact_orders"""))
def q_warehouse_incremental(spark, sf_dir):
    """Two loads into one folder, customers, products, sellers and days of the
    second unknown to the first: every order still joins to its own customer
    and day, and ``order_key`` is unique (the row of order -1 counts all).  A tenth
    of the orders has no purchase time; both loads hold some of them."""
    base = f"{ensure_checkpoint_dir(spark)}/starloom-incremental-{uuid.uuid4().hex}"
    raw = warehouse_from_testdata(spark, sf_dir).raw
    timed = raw.orders.withColumn("order_purchase_timestamp", F.when(F.col("order_id") % 10 != 3, F.col("order_purchase_timestamp")))
    early = F.coalesce(F.year("order_purchase_timestamp") < 1996, F.col("order_id") % 20 == 3) & (F.col("customer_id") % 2 == 1)
    for part in (early, ~early):
        orders = timed.where(part)
        # the fact joins items, payments and reviews to the load's orders only; sellers and
        # products are those of the load's items, looked up by distinct keys
        items = raw.items.join(orders.select("order_id"), "order_id", "left_semi")
        write_warehouse(Warehouse(replace(
            raw, orders=orders,
            customers=raw.customers.join(orders.select("customer_id").distinct(), "customer_id", "left_semi"),
            sellers=raw.sellers.join(items.select("seller_id").distinct(), "seller_id", "left_semi"),
            products=raw.products.join(items.select("product_id").distinct(), "product_id", "left_semi"))), base)
    wh = read_warehouse(spark, base)
    rows = (wh.fact.join(wh.customers.select("customer_key", "customer_id"), "customer_key", "left")
            .join(wh.dates.select(F.col("date_key").alias("order_date_key"), "full_date"), "order_date_key", "left"))
    counts = [F.count(F.lit(1)).alias("fact_rows"), F.countDistinct("order_key").alias("order_keys")]
    per_order = (rows.groupBy("order_id", "customer_id", "full_date").agg(*counts)
                 .select("order_id", "customer_id", F.col("full_date").cast("string").alias("order_date"), "fact_rows", "order_keys"))
    total = wh.fact.agg(*counts).select(F.lit(-1).cast("long").alias("order_id"), F.lit(None).cast("long").alias("customer_id"),
                                        F.lit(None).cast("string").alias("order_date"), "fact_rows", "order_keys")
    return per_order.unionByName(total)
