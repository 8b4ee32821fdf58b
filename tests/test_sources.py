"""CSV sources: header-driven columns, BOM, leading-zero ZIPs, bad timestamps."""

import os
import tempfile

from starloom.sources.csv import FILES, raw_from_csv
from starloom.plans.warehouse import Warehouse

ROWS = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01151,sao paulo,SP\nc1,u1,09999,zzz,SP\nc2,u2,22000,rio,RJ\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,13023,campinas,SP\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
                "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
                "p1,beleza_saude,40,287,1,225,16,10,14\np2,desconhecida,1,1,1,100,1,1,1\n",
    "categories": "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
              "o1,c1,delivered,2017-10-02 10:56:33,,,2017-10-10 21:25:13,2017-10-18 00:00:00\n"
              "o2,c2,delivered,junk,,,,2017-11-01 00:00:00\n"
              "o3,c2,canceled,2017-10-05 09:00:00,,,,2017-10-20 00:00:00\n",
    "items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
             "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72\no1,2,p2,s1,2017-10-06 11:07:15,10.00,1.00\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                "o1,2,voucher,1,10.00\no1,1,,1,5.00\no1,3,credit_card,4,33.71\n",
    "reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
               "review_creation_date,review_answer_timestamp\nr1,o1,2,,,,\nr2,o1,5,,,,\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
                   "01151,-23.5,-46.6,sao paulo,SP\n01151,-23.7,-46.8,sao paulo,SP\n01152,-23.0,-46.0,,SP\n",
}


def test_csv_warehouse(spark):
    folder = tempfile.mkdtemp(prefix="starloom-csv-")
    for name, text in ROWS.items():
        with open(os.path.join(folder, FILES[name]), "w", encoding="utf-8") as fh:
            fh.write(text)
    wh = Warehouse(raw_from_csv(spark, folder))
    cust = {r.customer_id: r for r in wh.customers.collect()}
    assert cust["c1"].customer_zip_code == "01151" and cust["c1"].customer_city == "sao paulo"
    prods = {r.product_id: r.category_name_english for r in wh.products.collect()}
    assert prods == {"p1": "health_beauty", "p2": None}
    assert wh.dates.count() == 3  # 10-02, 10-10, 10-05; 'junk' dropped
    geo = wh.geolocation.collect()
    assert len(geo) == 1 and abs(geo[0].latitude + 23.6) < 1e-9
    fact = {(r.order_id, str(r.price)): r for r in wh.fact.collect()}
    o1 = fact[("o1", "29.99")]
    assert o1.payment_type == "voucher" and str(o1.payment_value) == "48.71" and o1.payment_installments == 4
    assert o1.review_score == 5 and o1.days_to_deliver == 8
    assert fact[("o2", "None")].order_date_key is None and fact[("o2", "None")].price is None
    assert len(fact) == 4


def test_malformed_rows_counted(spark):
    from starloom.sources.csv import malformed_rows
    folder = tempfile.mkdtemp(prefix="starloom-csv-bad-")
    path = os.path.join(folder, "reviews.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("review_id,order_id,review_score\nr1,o1,5\nr2,o2\nr3,o3,4,extra\nr4,o4,1\n")
    r = malformed_rows(spark, path).first()
    assert r.rows == 4 and r.malformed_rows == 2


def test_csv_payment_rollup_needs_no_join(spark):
    folder = tempfile.mkdtemp(prefix="starloom-csv-agg-")
    for name, text in ROWS.items():
        with open(os.path.join(folder, FILES[name]), "w", encoding="utf-8") as fh:
            fh.write(text)
    from starloom.operators.fact import payments_per_order
    df = payments_per_order(raw_from_csv(spark, folder))
    got = {r.order_id: (r.payment_type, str(r.payment_value), r.payment_installments) for r in df.collect()}
    assert got == {"o1": ("voucher", "48.71", 4)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_" in plan


def test_quoted_line_breaks_stay_inside_a_review(spark):
    from starloom.operators.fact import reviews_per_order
    from starloom.sources.csv import malformed_rows
    folder = tempfile.mkdtemp(prefix="starloom-csv-lines-")
    text = ROWS["reviews"] + 'r3,o2,4,title,"two lines\no9,1 and a ""quote"", too",2018-01-01,2018-01-02\n'
    for name, content in {**ROWS, "reviews": text}.items():
        with open(os.path.join(folder, FILES[name]), "w", encoding="utf-8") as fh:
            fh.write(content)
    raw = raw_from_csv(spark, folder)
    assert {(r.order_id, r.review_score) for r in reviews_per_order(raw).collect()} == {("o1", 5), ("o2", 4)}
    assert all(raw.bound(name) >= getattr(raw, name).count() for name in FILES)
    r = malformed_rows(spark, os.path.join(folder, FILES["reviews"]), multi_line=True).first()
    assert r.rows == 3 and r.malformed_rows == 0


def test_quoted_breaks_at_every_range_border(spark, tmp_path):
    """Any cut of the file into byte ranges gives the rows of the one-task read."""
    from starloom.sources.quoted import read_quoted
    names = ["id", "title", "text"]
    rows = ["\ufeffid,title,text"]
    for i in range(60):
        text = ["plain", '"two\nlines"', '"a ""quoted"" word\n\n,comma"', '""', '"' + "long line\n" * (i % 9) + 'end"', "", '"x\r\ny"'][i % 7]
        rows.append(f"r{i},t{i % 3},{text}")
    path = str(tmp_path / "reviews.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(rows) + "\n")
    with open(str(tmp_path / "second.csv"), "w", encoding="utf-8", newline="") as f:
        f.write('"id","title","text"\r\nz1,a,"q\r\nq"\r\nz2,b,c')
    folder = str(tmp_path)
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder).toDF(*names)
    # (the one-task reader rewrites line breaks inside the fields of a CRLF file; here they stay as written)
    def shown(df):
        return sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in df.collect()), key=str)

    expected = shown(plain)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (37, 64, 150, 1000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = read_quoted(spark, folder, names)
            if size == 64:
                assert spark.read.text(folder).rdd.getNumPartitions() > 10
            assert shown(got) == expected
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(expected) == 62 and any("\n" in (r[2] or "") for r in expected)
