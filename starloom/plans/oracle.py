"""DuckDB SQL that rebuilds the same warehouse from the driver tables.

Used only to check the Spark plans (``oracle_sql()``): each oracle is this
prelude of CTEs followed by one SELECT.  The raw-source rules mirror
``sources.raw`` (FIXTURES.md part B); the warehouse rules mirror
``operators``.  Money is decimal, averages of money are exact sum / count.
"""

from __future__ import annotations

from ..sources.raw import CATEGORY_DICTIONARY, PAYMENT_SEQUENCE

_categories = ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_DICTIONARY)
_seq = ", ".join(PAYMENT_SEQUENCE)

PRELUDE = f"""
raw_customers AS (
  SELECT c.c_custkey AS customer_id,
         lpad(CAST(c.c_custkey % 1000 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
         c.c_mktsegment AS customer_city, n.n_name AS customer_state
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
raw_geolocation AS (
  SELECT lpad(CAST(c.c_custkey % 50 AS VARCHAR), 5, '0') AS zip_code,
         c.c_mktsegment AS city, n.n_name AS state,
         c.c_acctbal / 1000 AS latitude, c.c_nationkey - c.c_acctbal / 500 AS longitude
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
raw_sellers AS (
  SELECT s.s_suppkey AS seller_id, lpad(CAST(s.s_suppkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
         'CITY_' || CAST(s.s_suppkey % 10 AS VARCHAR) AS seller_city, n.n_name AS seller_state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
raw_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE lower(p_type) END AS product_category_name,
         CAST(p_size AS DOUBLE) * 100 AS product_weight_g, CAST(p_size AS DOUBLE) + 1 AS product_length_cm,
         CAST(p_size AS DOUBLE) / 2 AS product_height_cm, CAST(p_size AS DOUBLE) + 3 AS product_width_cm
  FROM part),
raw_categories AS (
  SELECT * FROM (VALUES {_categories}) t(product_category_name, product_category_name_english)),
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
         o_orderdate + to_hours(CAST(o_orderkey * 7 % 24 AS INT)) AS order_purchase_timestamp,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 <> 0
              THEN o_orderdate + to_days(CAST(o_orderkey % 37 AS INT)) + to_hours(CAST(o_orderkey * 5 % 24 AS INT)) END
           AS order_delivered_customer_date,
         o_orderdate + to_days(CAST(10 + o_orderkey % 20 AS INT)) AS order_estimated_delivery_date
  FROM orders),
raw_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS price,
         CAST(CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS DECIMAL(18,2))
           AS freight_value
  FROM lineitem),
raw_payments AS (
  SELECT l_orderkey AS order_id, {_seq},
         CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' WHEN 'R' THEN 'voucher' END AS payment_type,
         1 + CAST(trunc(l_quantity) AS INT) % 10 AS payment_installments,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS payment_value
  FROM lineitem),
payments_per_order AS (
  SELECT order_id, CAST(SUM(payment_value) AS DECIMAL(18,2)) AS payment_value,
         CAST(MAX(payment_installments) AS INT) AS payment_installments,
         first(payment_type ORDER BY {_seq}) FILTER (WHERE payment_type IS NOT NULL) AS payment_type
  FROM raw_payments GROUP BY order_id),
reviews_per_order AS (
  SELECT l_orderkey AS order_id, CAST(MAX(1 + (l_orderkey * 3 + l_linenumber) % 5) AS INT) AS review_score
  FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_linenumber <= 2 GROUP BY l_orderkey),
dim_customers AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, customer_city, customer_state, customer_zip_code
  FROM (SELECT customer_id, customer_city, customer_state, customer_zip_code_prefix AS customer_zip_code FROM raw_customers
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY customer_city NULLS FIRST,
                                   customer_state NULLS FIRST, customer_zip_code_prefix NULLS FIRST) = 1)),
dim_sellers AS (
  SELECT row_number() OVER (ORDER BY seller_id) AS seller_key, seller_id, seller_city, seller_state, seller_zip_code
  FROM (SELECT seller_id, seller_city, seller_state, seller_zip_code_prefix AS seller_zip_code FROM raw_sellers
        QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY seller_city NULLS FIRST,
                                   seller_state NULLS FIRST, seller_zip_code_prefix NULLS FIRST) = 1)),
dim_products AS (
  SELECT row_number() OVER (ORDER BY product_id) AS product_key, *
  FROM (SELECT p.product_id, p.product_category_name AS category_name,
               t.product_category_name_english AS category_name_english,
               product_weight_g, product_length_cm, product_height_cm, product_width_cm
        FROM raw_products p LEFT JOIN raw_categories t ON p.product_category_name = t.product_category_name
        QUALIFY row_number() OVER (PARTITION BY p.product_id ORDER BY category_name NULLS FIRST,
                category_name_english NULLS FIRST, product_weight_g NULLS FIRST, product_length_cm NULLS FIRST,
                product_height_cm NULLS FIRST, product_width_cm NULLS FIRST) = 1)),
dim_date AS (
  SELECT row_number() OVER (ORDER BY full_date) AS date_key, full_date,
         CAST(day(full_date) AS INT) AS day, CAST(month(full_date) AS INT) AS month,
         strftime(full_date, '%B') AS month_name, CAST(quarter(full_date) AS INT) AS quarter,
         CAST(year(full_date) AS INT) AS year, CAST(weekofyear(full_date) AS INT) AS week_of_year,
         strftime(full_date, '%A') AS day_of_week, isodow(full_date) >= 6 AS is_weekend
  FROM (SELECT DISTINCT d AS full_date FROM (
          SELECT CAST(order_purchase_timestamp AS DATE) AS d FROM raw_orders
          UNION ALL SELECT CAST(order_delivered_customer_date AS DATE) FROM raw_orders) WHERE d IS NOT NULL)),
dim_geolocation AS (
  SELECT row_number() OVER (ORDER BY zip_code, city, state) AS geo_key, zip_code, city, state,
         CAST(sum(CAST(latitude AS DECIMAL(38,12))) AS DOUBLE) / count(latitude) AS latitude,
         CAST(sum(CAST(longitude AS DECIMAL(38,12))) AS DOUBLE) / count(longitude) AS longitude
  FROM raw_geolocation WHERE zip_code IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL
  GROUP BY zip_code, city, state),
orders_level AS (
  SELECT o.order_id, c.customer_key, od.date_key AS order_date_key, dd.date_key AS delivered_date_key, o.order_status,
         CAST(floor(date_diff('second', o.order_purchase_timestamp, o.order_delivered_customer_date) / 86400.0) AS INT)
           AS days_to_deliver,
         CAST(floor(date_diff('second', o.order_purchase_timestamp, o.order_estimated_delivery_date) / 86400.0) AS INT)
           AS days_estimated,
         o.order_purchase_timestamp, o.order_delivered_customer_date AS order_delivered_timestamp,
         p.payment_value, p.payment_installments, p.payment_type, r.review_score
  FROM raw_orders o
  LEFT JOIN dim_customers c ON o.customer_id = c.customer_id
  LEFT JOIN dim_date od ON CAST(o.order_purchase_timestamp AS DATE) = od.full_date
  LEFT JOIN dim_date dd ON CAST(o.order_delivered_customer_date AS DATE) = dd.full_date
  LEFT JOIN payments_per_order p ON o.order_id = p.order_id
  LEFT JOIN reviews_per_order r ON o.order_id = r.order_id),
items_level AS (
  SELECT i.order_id, s.seller_key, pr.product_key, i.price, i.freight_value
  FROM raw_items i LEFT JOIN dim_sellers s ON i.seller_id = s.seller_id
  LEFT JOIN dim_products pr ON i.product_id = pr.product_id),
fact_orders AS (
  SELECT o.order_id, o.customer_key, i.seller_key, i.product_key, o.order_date_key, o.delivered_date_key,
         o.order_status, i.price, i.freight_value, o.payment_value, o.payment_installments, o.payment_type,
         o.days_to_deliver, o.days_estimated, o.days_to_deliver - o.days_estimated AS delivery_delay_days,
         o.review_score, o.order_purchase_timestamp, o.order_delivered_timestamp
  FROM orders_level o LEFT JOIN items_level i ON o.order_id = i.order_id)
"""


def oracle(select: str, extra_ctes: str = "") -> str:
    """Prelude + optional extra CTEs + the final SELECT."""
    ctes = PRELUDE.rstrip() + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{select.strip()}"
