"""Feature-table, exact-metric and daily-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import exact_median
from ..operators import customers as C
from ..operators import marts, metrics, series
from ..operators import reviews as R
from ..plans.catalog import register
from ..plans.oracle import oracle
from ..plans.warehouse import loaded_warehouse, warehouse_from_testdata
from ..sources.tables import read_table, row_count


def _wh(spark, sf_dir):
    """The loaded star schema (built once per session)."""
    return loaded_warehouse(spark, sf_dir)


def _etl(spark, sf_dir):
    """The star schema as a fresh plan over the raw sources."""
    return warehouse_from_testdata(spark, sf_dir)


def _ratio_sql(num: str, den: str) -> str:
    return (f"CASE WHEN CAST({den} AS DOUBLE) + 1 = 0 THEN NULL "
            f"ELSE CAST({num} AS DOUBLE) / (CAST({den} AS DOUBLE) + 1) END")


def _customer_sql(min_orders: int) -> str:
    """From one row per customer and order, and the categories counted apart."""
    return f"""
SELECT customer_id, total_orders, total_spent, avg_order_value, avg_freight, avg_delivery_days, avg_review_score, avg_delay,
       total_installments, unique_categories, last_purchase, first_purchase,
       {_ratio_sql('total_spent', 'avg_delivery_days')} AS price_per_day, {_ratio_sql('avg_freight', 'avg_order_value')} AS freight_ratio
FROM (SELECT customer_key, count(*) AS total_orders, CAST(sum(price) AS DOUBLE) AS total_spent,
             CAST(sum(price) AS DOUBLE) / sum(n_price) AS avg_order_value, CAST(sum(freight) AS DOUBLE) / sum(n_freight) AS avg_freight,
             CAST(sum(days * items) AS DOUBLE) / CAST(sum(items) AS DOUBLE) AS avg_delivery_days,
             CAST(sum(score * items) AS DOUBLE) / CAST(sum(items) AS DOUBLE) AS avg_review_score,
             CAST(sum(delay * items) AS DOUBLE) / CAST(sum(items) FILTER (WHERE delay IS NOT NULL) AS DOUBLE) AS avg_delay,
             CAST(sum(installments) AS BIGINT) AS total_installments, max(bought) AS last_purchase, min(bought) AS first_purchase
      FROM (SELECT customer_key, order_id, sum(price) AS price, count(price) AS n_price, sum(freight_value) AS freight,
                   count(freight_value) AS n_freight, count(*) AS items, min(days_to_deliver) AS days, min(review_score) AS score,
                   min(delivery_delay_days) AS delay, sum(payment_installments) AS installments, min(order_purchase_timestamp) AS bought
            FROM fact_orders SEMI JOIN dim_products USING (product_key)
            WHERE review_score IS NOT NULL AND days_to_deliver IS NOT NULL AND order_status = 'delivered'
            GROUP BY customer_key, order_id)
      GROUP BY customer_key)
JOIN dim_customers USING (customer_key)
JOIN (SELECT customer_key, count(DISTINCT category_name_english) AS unique_categories
      FROM fact_orders JOIN dim_products USING (product_key)
      WHERE review_score IS NOT NULL AND days_to_deliver IS NOT NULL AND order_status = 'delivered'
      GROUP BY customer_key) USING (customer_key)
WHERE total_orders >= {min_orders}"""


CF_CTE = "cf AS (" + _customer_sql(1) + ")"


# At order grain first: which orders were judged; then their items, with scalar lookups.
REVIEW_BASE_CTE = """
judged AS (
  SELECT *, days_to_deliver - days_estimated AS delivery_delay_days,
         (SELECT c.customer_state FROM dim_customers c WHERE c.customer_key = orders_level.customer_key) AS customer_state
  FROM orders_level
  WHERE review_score + days_to_deliver IS NOT NULL AND order_status = 'delivered' AND customer_key IS NOT NULL),
base AS (
  SELECT order_id, product_key, seller_key, price, freight_value, payment_value, payment_installments,
         days_to_deliver, days_estimated, delivery_delay_days, payment_type, review_score, order_status, customer_state,
         (SELECT q.category_name_english FROM dim_products q WHERE q.product_key = items_level.product_key) AS product_category,
         (SELECT v.seller_state FROM dim_sellers v WHERE v.seller_key = items_level.seller_key) AS seller_state
  FROM items_level NATURAL JOIN judged
  WHERE product_key + seller_key IS NOT NULL),
ranked AS (
  SELECT CAST(price AS DOUBLE) AS x, row_number() OVER (ORDER BY CAST(price AS DOUBLE)) AS rn,
         count(*) OVER () AS n FROM base WHERE price IS NOT NULL),
med AS (
  SELECT (max(x) FILTER (WHERE rn = (n - 1) // 2 + 1) + max(x) FILTER (WHERE rn = n // 2 + 1)) / 2 AS m FROM ranked)"""

_ENGINEERED = f"""
  CAST(COALESCE(delivery_delay_days < 0, false) AS INT) AS delivered_early,
  days_to_deliver - days_estimated AS delivery_gap,
  {_ratio_sql('freight_value', 'price')} AS freight_ratio,
  {_ratio_sql('price', 'payment_value')} AS price_to_payment"""

REVIEW_FEATURES_CTE = REVIEW_BASE_CTE + f""",
rf AS (
  SELECT order_id, product_key, seller_key, price, freight_value, payment_value, payment_installments,
         days_to_deliver, days_estimated, delivery_delay_days, {_ENGINEERED},
         CAST(COALESCE(CAST(price AS DOUBLE) > (SELECT m FROM med), false) AS INT) AS expensive_item,
         CAST(COALESCE(payment_installments > 3, false) AS INT) AS high_installments,
         COALESCE(payment_type, 'unknown') AS payment_type, COALESCE(product_category, 'unknown') AS product_category,
         COALESCE(customer_state, 'unknown') AS customer_state, COALESCE(seller_state, 'unknown') AS seller_state,
         CAST(review_score >= 4 AS INT) AS review_good
  FROM base)"""


def _codes_sql() -> str:
    parts = [f"""SELECT '{c}' AS column_name, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code
  FROM (SELECT DISTINCT COALESCE({c}, 'unknown') AS value FROM base)""" for c in R.CATEGORICAL]
    return "codes AS (" + "\n  UNION ALL ".join(parts) + ")"


COMPLETE_CTE = REVIEW_BASE_CTE + ",\n" + _codes_sql() + f""",
pre AS (
  SELECT order_id, product_key, seller_key, price, freight_value, payment_value, payment_installments,
         days_to_deliver, days_estimated, delivery_delay_days, {_ENGINEERED},
         COALESCE(payment_type, 'unknown') AS payment_type, COALESCE(product_category, 'unknown') AS product_category,
         COALESCE(customer_state, 'unknown') AS customer_state, COALESCE(seller_state, 'unknown') AS seller_state,
         CAST(review_score >= 4 AS INT) AS review_good
  FROM base),
rfc AS (
  SELECT order_id, product_key, seller_key, price, freight_value, payment_value, payment_installments,
         k1.code AS payment_type, days_to_deliver, days_estimated, delivery_delay_days, delivered_early,
         freight_ratio, price_to_payment, k2.code AS product_category, k3.code AS customer_state,
         k4.code AS seller_state, review_good
  FROM pre
  LEFT JOIN codes k1 ON k1.column_name = 'payment_type' AND k1.value = pre.payment_type
  LEFT JOIN codes k2 ON k2.column_name = 'product_category' AND k2.value = pre.product_category
  LEFT JOIN codes k3 ON k3.column_name = 'customer_state' AND k3.value = pre.customer_state
  LEFT JOIN codes k4 ON k4.column_name = 'seller_state' AND k4.value = pre.seller_state
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['price', 'freight_value', 'payment_value', 'payment_installments',
                                                    'days_to_deliver', 'days_estimated', 'delivery_delay_days',
                                                    'freight_ratio', 'price_to_payment'])})"""

_RANK_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ["h"] + R.IDS + R.COMPLETE_FEATURES)
RANKED_CTE = COMPLETE_CTE + f""",
cr AS (
  SELECT order_id, product_key, seller_key, review_good,
         row_number() OVER (PARTITION BY review_good ORDER BY {_RANK_ORDER}) - 1 AS class_rank,
         count(*) OVER (PARTITION BY review_good) AS class_rows
  FROM (SELECT *, (order_id * 7919 + product_key * 31 + seller_key) % 1000003 AS h FROM rfc))"""

SCORES_CTE = """
scores AS (
  SELECT CAST(1 + (l_orderkey * 3 + l_linenumber) % 5 >= 4 AS INT) AS label,
         CAST((l_orderkey * 7919 + l_linenumber * 31) % 1000 AS DOUBLE) / 1000 AS p
  FROM lineitem)"""

# Days from order rows: one row an order, its items summed before.
DAILY_SALES_CTE = """
spent AS (SELECT order_id, sum(price) AS spent FROM items_level GROUP BY order_id),
daily AS (
  SELECT CAST(order_purchase_timestamp AS DATE) AS ds, CAST(sum(spent) AS DECIMAL(38,2)) AS revenue, count(*) AS total_orders
  FROM orders_level LEFT JOIN spent USING (order_id)
  WHERE order_status = 'delivered' AND order_date_key IS NOT NULL GROUP BY ALL)"""

DAILY_ORDERS_CTE = DAILY_SALES_CTE


# ------------------------------------------------------------ customers

@register("customer_features", oracle(_customer_sql(1)))
def q_customer_features(spark, sf_dir):
    return C.customer_features(_wh(spark, sf_dir))


@register("repeat_customers", oracle(_customer_sql(2)))
def q_repeat_customers(spark, sf_dir):
    return C.customer_features(_wh(spark, sf_dir), min_orders=2)


@register("customer_rfm", oracle("""
SELECT customer_id, last_purchase, first_purchase,
       CAST(floor(date_diff('second', last_purchase, max(last_purchase) OVER ()) / 86400.0) AS INT) AS recency,
       CAST(floor(date_diff('second', first_purchase, last_purchase) / 86400.0) AS INT) AS customer_lifetime_days
FROM cf""", CF_CTE))
def q_customer_rfm(spark, sf_dir):
    return C.customer_rfm(C.customer_features(_wh(spark, sf_dir)))


@register("log_spend", oracle("""
SELECT customer_id, round(ln(1 + total_spent), 9) AS total_spent, round(ln(1 + avg_order_value), 9) AS avg_order_value,
       round(ln(1 + price_per_day), 9) AS price_per_day
FROM cf""", CF_CTE))
def q_log_spend(spark, sf_dir):
    logged = C.log_spend(C.customer_features(_wh(spark, sf_dir)))
    return logged.select("customer_id", *[F.round(c, 9).alias(c) for c in C.LOG_FEATURES])


def scaled_sql() -> str:
    cols = C.SEGMENT_FEATURES
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in cols)
    z = ", ".join(f"round(({c} - avg({c}) OVER ()) / COALESCE(NULLIF(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
                  for c in cols)
    return f"SELECT customer_id, {z} FROM (SELECT customer_id, {filled} FROM cf)"


@register("customer_features_scaled", oracle(scaled_sql(), CF_CTE))
def q_customer_features_scaled(spark, sf_dir):
    scaled = C.standardize(C.customer_features(_wh(spark, sf_dir)))
    return scaled.select("customer_id", *[F.round(c, 6).alias(c) for c in C.SEGMENT_FEATURES])


@register("customer_sample_500", oracle("SELECT * FROM cf ORDER BY customer_id LIMIT 500", CF_CTE))
def q_customer_sample_500(spark, sf_dir):
    """The serving query's 500 customers, made deterministic: lowest ids."""
    return C.customer_features(_wh(spark, sf_dir)).orderBy("customer_id").limit(500)


# ------------------------------------------------------------- reviews

@register("review_features", oracle("SELECT * FROM rf", REVIEW_FEATURES_CTE))
def q_review_features(spark, sf_dir):
    return R.review_features(_wh(spark, sf_dir))


@register("price_median_flag", oracle("""
SELECT (SELECT m FROM med) AS median_price, CAST(count(*) AS BIGINT) AS rows,
       CAST(sum(expensive_item) AS BIGINT) AS expensive_rows
FROM rf""", REVIEW_FEATURES_CTE))
def q_price_median_flag(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    med = exact_median(R.review_base(wh), "price")
    rf = R.review_features(wh, median_price=med)
    return rf.agg(F.lit(med).cast("double").alias("median_price"), F.count(F.lit(1)).alias("rows"),
                  F.sum("expensive_item").cast("long").alias("expensive_rows"))


@register("class_balance", oracle("""
SELECT count(*) AS samples, CAST(sum(review_good) AS BIGINT) AS positives,
       count(*) - CAST(sum(review_good) AS BIGINT) AS negatives,
       CAST(sum(review_good) AS DOUBLE) / count(*) AS positive_rate,
       CAST(count(*) - sum(review_good) AS DOUBLE) / CAST(sum(review_good) AS DOUBLE) AS scale_pos_weight
FROM rf""", REVIEW_FEATURES_CTE))
def q_class_balance(spark, sf_dir):
    return R.class_balance(R.review_labels(_wh(spark, sf_dir)))


@register("review_features_complete", oracle("SELECT * FROM rfc", COMPLETE_CTE))
def q_review_features_complete(spark, sf_dir):
    return R.review_features_complete(_wh(spark, sf_dir))


@register("label_encode", oracle("SELECT * FROM codes", REVIEW_BASE_CTE + ",\n" + _codes_sql()))
def q_label_encode(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    return R.label_codes(R.review_base(wh))


@register("stratified_split", oracle("""
SELECT order_id, product_key, seller_key, review_good,
       CASE WHEN class_rank * 5 < class_rows THEN 'test' ELSE 'train' END AS split
FROM cr""", RANKED_CTE))
def q_stratified_split(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    s = R.stratified_split(R.review_features_complete(wh), row_bound=wh.bound("items"))
    return s.select(*R.IDS, R.TARGET, "split")


@register("stratified_folds", oracle("""
SELECT order_id, product_key, seller_key, review_good, CAST(class_rank % 5 AS INT) AS fold FROM cr""", RANKED_CTE))
def q_stratified_folds(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    s = R.stratified_folds(R.review_features_complete(wh), row_bound=wh.bound("items"))
    return s.select(*R.IDS, R.TARGET, "fold")


# ------------------------------------------------------- exact metrics

def _scores(spark, sf_dir):
    return metrics.score_table(read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"))


def _div_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def _counts_sql(t: float) -> str:
    return f"""SELECT CAST({t} AS DOUBLE) AS threshold,
         count(*) FILTER (WHERE label = 1 AND p >= CAST({t} AS DOUBLE)) AS tp,
         count(*) FILTER (WHERE label <> 1 AND p >= CAST({t} AS DOUBLE)) AS fp,
         count(*) FILTER (WHERE label = 1 AND p < CAST({t} AS DOUBLE)) AS fn,
         count(*) FILTER (WHERE label <> 1 AND p < CAST({t} AS DOUBLE)) AS tn FROM scores"""


def _div_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


_F1 = _div_sql("2 * tp", "2 * tp + fp + fn")
_F1N = _div_sql("2 * tn", "2 * tn + fn + fp")


@register("threshold_metrics", oracle(f"""
SELECT threshold, tp, fp, fn, tn,
       {_div_sql('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
       {_div_sql('tp', 'tp + fp')} AS precision,
       {_div_sql('tp', 'tp + fn')} AS recall,
       {_F1} AS f1, {_F1N} AS f1_negative,
       ({_F1} + {_F1N}) / 2 AS macro_f1,
       {_div_sql(f'({_F1}) * (tp + fn) + ({_F1N}) * (tn + fp)', 'tp + fp + fn + tn')} AS weighted_f1
FROM ({_counts_sql(0.4)} UNION ALL {_counts_sql(0.25)})""", SCORES_CTE))
def q_threshold_metrics(spark, sf_dir):
    return metrics.threshold_metrics(_scores(spark, sf_dir))


@register("classification_report", oracle(f"""
SELECT threshold, class, precision, recall, f1, support FROM (
  SELECT threshold, class, {_div_sql("hit", "predicted")} AS precision, {_div_sql("hit", "support")} AS recall,
         {_div_sql("2 * hit", "predicted + support")} AS f1, support FROM per_class
  UNION ALL
  SELECT threshold, 'macro avg', avg({_div_sql("hit", "predicted")}), avg({_div_sql("hit", "support")}),
         avg({_div_sql("2 * hit", "predicted + support")}), CAST(sum(support) AS BIGINT) FROM per_class GROUP BY threshold
  UNION ALL
  SELECT threshold, 'weighted avg', sum({_div_sql("hit", "predicted")} * support) / CAST(sum(support) AS DOUBLE),
         sum({_div_sql("hit", "support")} * support) / CAST(sum(support) AS DOUBLE),
         sum({_div_sql("2 * hit", "predicted + support")} * support) / CAST(sum(support) AS DOUBLE),
         CAST(sum(support) AS BIGINT) FROM per_class GROUP BY threshold)""", SCORES_CTE + """,
per_class AS (
  SELECT CAST(0.4 AS DOUBLE) AS threshold, CASE y WHEN 0 THEN 'bad' ELSE 'good' END AS class,
         count(*) FILTER (WHERE label = y AND guess = y) AS hit, count(*) FILTER (WHERE guess = y) AS predicted,
         count(*) FILTER (WHERE label = y) AS support
  FROM (SELECT label, CAST(p >= CAST(0.4 AS DOUBLE) AS INT) AS guess FROM scores), (VALUES (0), (1)) c(y) GROUP BY y)"""))
def q_classification_report(spark, sf_dir):
    return metrics.classification_report(_scores(spark, sf_dir), 0.40)


@register("confusion_matrix", oracle("""
SELECT label AS actual, CAST(p >= CAST(0.4 AS DOUBLE) AS INT) AS predicted, count(*) AS n
FROM scores GROUP BY ALL""", SCORES_CTE))
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_scores(spark, sf_dir), 0.40)


@register("roc_auc", oracle("""
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
       CAST(sum(CAST(pos AS DECIMAL(38,0)) * (2 * neg_before + neg)) AS DOUBLE)
         / (2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
FROM (SELECT *, COALESCE(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
      FROM (SELECT p AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
            FROM scores GROUP BY p))""", SCORES_CTE))
def q_roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scores(spark, sf_dir), row_count(spark, sf_dir, "lineitem"))


# --------------------------------------------------------- daily series

@register("trailing_14", oracle("""
SELECT ds, total_orders, avg(total_orders) OVER (ORDER BY ds ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS trailing_14
FROM daily""", DAILY_ORDERS_CTE))
def q_trailing_14(spark, sf_dir):
    return series.trailing_mean(marts.daily_orders(_wh(spark, sf_dir)))


_FUTURE_SQL = """
cal AS (
  SELECT ds, false AS is_future FROM daily
  UNION ALL SELECT CAST(m + CAST(i AS INT) AS DATE) AS ds, true AS is_future
  FROM (SELECT max(ds) AS m FROM daily), range(1, 31) t(i))"""


@register("future_calendar", oracle("SELECT * FROM cal", DAILY_ORDERS_CTE + "," + _FUTURE_SQL))
def q_future_calendar(spark, sf_dir):
    return series.future_calendar(marts.daily_orders(_wh(spark, sf_dir)))


@register("future_regressor", oracle("""
SELECT c.ds, c.is_future,
       COALESCE(CAST(d.total_orders AS DOUBLE),
                (SELECT avg(total_orders) FROM (SELECT total_orders FROM daily ORDER BY ds DESC LIMIT 14))) AS total_orders
FROM cal c LEFT JOIN daily d ON c.ds = d.ds""", DAILY_ORDERS_CTE + "," + _FUTURE_SQL))
def q_future_regressor(spark, sf_dir):
    return series.future_regressor(marts.daily_orders(_wh(spark, sf_dir)))


@register("daily_sales_trimmed", oracle("""
SELECT * FROM daily
WHERE ds BETWEEN (SELECT min(ds) FROM daily WHERE total_orders * 10 >= (SELECT median(total_orders) FROM daily))
             AND (SELECT max(ds) FROM daily WHERE total_orders * 10 >= (SELECT median(total_orders) FROM daily))""",
    DAILY_SALES_CTE))
def q_daily_sales_trimmed(spark, sf_dir):
    return series.trim_boundary_days(marts.daily_sales(_wh(spark, sf_dir)))


@register("forecast_error", oracle("""
SELECT count(*) AS n, CAST(sum(abs(y - yhat)) AS DOUBLE) / count(*) AS mae,
       sqrt(CAST(sum((y - yhat) * (y - yhat)) AS DOUBLE) / count(*)) AS rmse,
       round(sum(CASE WHEN y <> 0 THEN CAST(abs(y - yhat) AS DOUBLE) / CAST(y AS DOUBLE) END)
             / count(*) FILTER (WHERE y <> 0), 9) AS mape,
       1 - CAST(sum((y - yhat) * (y - yhat)) AS DOUBLE)
         / (CAST(sum(y * y) AS DOUBLE) - CAST(sum(y) AS DOUBLE) * CAST(sum(y) AS DOUBLE) / count(*)) AS r2
FROM (SELECT CAST(d.revenue AS DECIMAL(18,2)) AS y, CAST(p.revenue AS DECIMAL(18,2)) AS yhat
      FROM daily d JOIN daily p ON d.ds = p.ds + 7
      WHERE d.revenue IS NOT NULL AND p.revenue IS NOT NULL)""", DAILY_SALES_CTE))
def q_forecast_error(spark, sf_dir):
    """Error metrics of the naive lag-7 forecast over the daily revenue."""
    return series.forecast_error(series.lag_forecast(marts.daily_sales(_wh(spark, sf_dir))))


@register("daily_sales_summary", oracle("""
SELECT count(*) AS days, CAST(sum(revenue) AS DECIMAL(38,2)) AS total,
       CAST(sum(revenue) AS DOUBLE) / count(revenue) AS daily_average, max(revenue) AS peak,
       (SELECT strftime(min(ds), '%Y-%m-%d') FROM recent WHERE revenue = (SELECT max(revenue) FROM recent)) AS peak_day
FROM recent""", DAILY_SALES_CTE + ",\nrecent AS (SELECT * FROM daily WHERE ds > (SELECT max(ds) FROM daily) - 30)"))
def q_daily_sales_summary(spark, sf_dir):
    return series.window_summary(marts.daily_sales(_wh(spark, sf_dir)), "revenue", 30)
