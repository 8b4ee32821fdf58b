"""A hot order holding a third of all items: the salted 1:N expansion
spreads it over several tasks, and the result is unchanged."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F


def test_hot_order_is_split_and_result_exact(spark, monkeypatch):
    import starloom.operators.joins as J
    from starloom.operators.fact import fact_orders
    from starloom.plans.warehouse import Warehouse, write_warehouse
    from starloom.sources.raw import RawTables

    monkeypatch.setattr(J, "BROADCAST_ROW_LIMIT", 0)
    monkeypatch.setattr(J, "HOT_KEY_ROWS", 500)
    t0 = dt.datetime(2020, 1, 1, 10)
    orders = spark.createDataFrame(
        [(o, o % 7, "delivered", t0 + dt.timedelta(days=o % 30), t0 + dt.timedelta(days=o % 30 + 3),
          t0 + dt.timedelta(days=o % 30 + 9)) for o in range(400)],
        "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz, "
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
    hot = [(1, i % 50, i % 5) for i in range(6000)]
    rest = [(o, o % 50, o % 5) for o in range(2, 400) for _ in range(30)]
    items = spark.createDataFrame(hot + rest, "order_id long, product_id long, seller_id long").select(
        "order_id", "product_id", "seller_id", F.lit(10).cast("decimal(18,2)").alias("price"),
        F.lit(1).cast("decimal(18,2)").alias("freight_value"))
    customers = spark.createDataFrame([(c, "00001", "city", "ST") for c in range(7)],
                                      "customer_id long, customer_zip_code_prefix string, customer_city string, "
                                      "customer_state string")
    sellers = spark.createDataFrame([(s, "00001", "c", "ST") for s in range(5)],
                                    "seller_id long, seller_zip_code_prefix string, seller_city string, "
                                    "seller_state string")
    products = spark.createDataFrame([(p, "small", 1.0, 1.0, 1.0, 1.0) for p in range(50)],
                                     "product_id long, product_category_name string, product_weight_g double, "
                                     "product_length_cm double, product_height_cm double, product_width_cm double")
    categories = spark.createDataFrame([("small", "small_goods")], "product_category_name string, "
                                       "product_category_name_english string")
    payments = spark.createDataFrame([(o, (1,), "boleto", 1, 5) for o in range(400)],
                                     "order_id long, payment_sequence struct<s:int>, payment_type string, "
                                     "payment_installments int, payment_value int").withColumn(
        "payment_value", F.col("payment_value").cast("decimal(18,2)"))
    reviews = spark.createDataFrame([(o, 5) for o in range(400)], "order_id long, review_score int")
    geo = spark.createDataFrame([("00001", "c", "ST", 1.0, 1.0)], "geolocation_zip_code_prefix string, "
                                "geolocation_city string, geolocation_state string, geolocation_lat double, "
                                "geolocation_lng double")
    bounds = {"customers": 7, "sellers": 5, "products": 50, "categories": 1, "orders": 400,
              "items": len(hot) + len(rest), "payments": 400, "reviews": 400, "geolocation": 1}
    raw = RawTables(customers, sellers, products, categories, orders, items, payments, reviews, geo, bounds)

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        path = tempfile.mkdtemp(prefix="starloom-skew-")
        write_warehouse(Warehouse(raw), path)
        files = (spark.read.parquet(f"{path}/fact_orders").where(F.col("order_id") == 1)
                 .groupBy(F.input_file_name().alias("f")).count().collect())
        fact = fact_orders(raw, Warehouse(raw))
        got = fact.groupBy("order_id").count().collect()
        spread = (fact.where(F.col("order_id") == 1).groupBy(F.spark_partition_id().alias("p")).count()
                  .agg(F.count(F.lit(1)).alias("parts"), F.max("count").alias("biggest")).first())
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    counts = {r.order_id: r["count"] for r in got}
    assert counts[1] == 6000 and counts[0] == 1 and counts[2] == 30 and len(counts) == 400
    # the hot order's 6000 items are split over 12 salt buckets, not one task
    assert spread.parts > 1 and spread.biggest < 6000
    # and stay split where the load writes them
    assert len(files) > 1 and sum(r["count"] for r in files) == 6000
