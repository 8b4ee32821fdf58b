"""Golden anchors on sf0.01 (FIXTURES.md) and warehouse invariants."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001


@pytest.fixture(scope="module")
def wh(spark):
    from starloom.plans.warehouse import loaded_warehouse
    return loaded_warehouse(spark, SF001)


def test_fact_anchors(wh):
    f = wh.fact
    r = f.agg(F.count(F.lit(1)).alias("n"), F.count("product_key").alias("with_product"),
              F.count("days_to_deliver").alias("with_days"), F.count("review_score").alias("with_score"),
              F.min("delivery_delay_days").alias("dmin"), F.max("delivery_delay_days").alias("dmax"),
              F.sum("payment_installments").alias("inst"), F.sum("payment_value").alias("pv"),
              F.count_if(F.col("payment_type") == "boleto").alias("boleto")).first()
    assert (r.n, r.with_product, r.with_days, r.with_score) == (60257, 60000, 19537, 41527)
    assert (r.dmin, r.dmax) == (-29, 27)
    assert r.inst == 514002 and r.pv == Decimal("15870835322.00") and r.boleto == 20318


def test_dimension_anchors(wh):
    d = wh.dates.agg(F.count(F.lit(1)).alias("n"), F.min("full_date").alias("lo"), F.max("full_date").alias("hi")).first()
    assert d.n == 2424 and str(d.lo) == "1995-01-01" and str(d.hi) == "2001-08-31"
    assert wh.geolocation.count() == 1310


def test_status_anchors(wh):
    from starloom.plans.warehouse import raw_tables
    o = wh.raw.orders.groupBy("order_status").count().collect()
    assert {r.order_status: r["count"] for r in o} == {"canceled": 5088, "shipped": 4979, "delivered": 4933}


def test_mart_anchors(queries, spark):
    cats = {r.category: (r.total_orders, r.total_revenue) for r in queries["sales_by_category"](spark, SF001).collect()}
    assert cats[None] == (7748, 573973465.37)
    assert cats["medium_goods"] == (7483, 551477627.87)
    assert cats["value_line"] == (6766, 485145782.34)
    m = queries["monthly_sales"](spark, SF001).collect()
    assert len(m) == 79 and (m[0].year, m[0].month, m[0].total_orders) == (1995, 1, 66)
    assert m[0].total_revenue == 15395036.92


def test_feature_anchors(queries, spark):
    assert queries["customer_features"](spark, SF001).count() == 1307
    rf = queries["review_features"](spark, SF001)
    r = rf.agg(F.count(F.lit(1)).alias("n"), F.sum("review_good").alias("good"),
               F.sum("delivered_early").alias("early")).first()
    assert (r.n, r.good, r.early) == (13790, 7210, 7381)
    assert queries["price_median_flag"](spark, SF001).first().median_price == 52861.335


def test_auc_anchor(queries, spark):
    r = queries["roc_auc"](spark, SF001).first()
    assert r.positives == 24171 and r.roc_auc == 0.49993748836339763


def test_invariants(wh):
    f = wh.fact
    items = wh.raw.items.count()
    itemless = wh.raw.orders.join(wh.raw.items.select("order_id").distinct(), "order_id", "left_anti").count()
    assert f.count() == items + itemless
    assert f.agg(F.sum("price")).first()[0] == wh.raw.items.agg(F.sum("price")).first()[0]
    for dim, key in ((wh.customers, "customer_key"), (wh.products, "product_key"), (wh.dates, "date_key")):
        assert dim.select(key).distinct().count() == dim.count()


def test_quality_checks_clean(queries, spark):
    assert all(r.duplicate_keys == 0 for r in queries["dq_duplicate_keys"](spark, SF001).collect())
    assert all(r.orphan_rows == 0 for r in queries["dq_orphans"](spark, SF001).collect())


def test_order_key_unique_and_follows_purchase_time(wh):
    from pyspark.sql import Window
    f = wh.fact
    assert f.select("order_key").distinct().count() == f.count()
    w = Window.orderBy("order_key")
    back = f.select("order_purchase_timestamp", F.lag("order_purchase_timestamp").over(w).alias("prev"))
    assert back.where(F.col("prev") > F.col("order_purchase_timestamp")).count() == 0


def test_second_load_keeps_keys(spark):
    """Customers and days that arrive later get new keys; the rows of the
    first load stay as they are."""
    import tempfile
    from dataclasses import replace

    from pyspark.sql import functions as F

    from starloom.plans.warehouse import Warehouse, read_warehouse, warehouse_from_testdata, write_warehouse
    raw = warehouse_from_testdata(spark, SF0001).raw
    path = tempfile.mkdtemp(prefix="starloom-loads-")
    first = (F.year("order_purchase_timestamp") < 1998) & (F.col("customer_id") % 3 > 0)
    seen = []
    for part in (first, ~first, ~first):                # the last load is repeated
        orders = raw.orders.where(part)
        ids = orders.select("order_id")
        write_warehouse(Warehouse(replace(
            raw, orders=orders, customers=raw.customers.join(orders.select("customer_id"), "customer_id", "left_semi"),
            **{t: getattr(raw, t).join(ids, "order_id", "left_semi") for t in ("items", "payments", "reviews")})), path)
        wh = read_warehouse(spark, path)
        seen.append(({r.order_key: r for r in wh.fact.collect()}, {r.customer_id: r.customer_key for r in wh.customers.collect()},
                     {r.full_date: r.date_key for r in wh.dates.collect()}, wh.fact.count()))
    for older, newer in zip(seen, seen[1:]):
        assert all(newer[0][k] == r for k, r in older[0].items() if k in newer[0])
        assert older[1].items() <= newer[1].items() and older[2].items() <= newer[2].items()
        assert len(newer[0]) == newer[3]                # order_key is unique
    assert all(k in seen[2][0] for k in seen[0][0])     # the first load's rows are all there
    assert seen[1][3] == seen[2][3] == warehouse_from_testdata(spark, SF0001).fact.count()
    assert len(set(seen[2][1].values())) == len(seen[2][1]) and len(set(seen[2][2].values())) == len(seen[2][2])


def _loads(spark, path, parts, **changes):
    from dataclasses import replace
    from starloom.plans.warehouse import Warehouse, read_warehouse, warehouse_from_testdata, write_warehouse
    raw = replace(warehouse_from_testdata(spark, SF0001).raw, **changes)
    for part in parts:
        orders = raw.orders.where(part)
        ids = orders.select("order_id")
        write_warehouse(Warehouse(replace(
            raw, orders=orders, **{t: getattr(raw, t).join(ids, "order_id", "left_semi") for t in ("items", "payments", "reviews")})), path)
    return read_warehouse(spark, path)


def test_orders_without_a_time_survive_reloads(spark, tmp_path):
    """Null months, a null natural key, and an order whose month changes."""
    from starloom.plans.warehouse import warehouse_from_testdata
    raw = warehouse_from_testdata(spark, SF0001).raw
    orders = raw.orders.withColumn("order_purchase_timestamp", F.when(F.col("order_id") % 10 != 3, F.col("order_purchase_timestamp")))
    customers = raw.customers.union(raw.customers.limit(1).withColumn("customer_id", F.lit(None).cast("long")))
    odd = F.col("order_id") % 2 == 1
    wh = _loads(spark, str(tmp_path), (odd, ~odd, odd), orders=orders, customers=customers)
    whole = warehouse_from_testdata(spark, SF0001).fact
    count = lambda df: {r.order_id: r["count"] for r in df.groupBy("order_id").count().collect()}
    assert count(wh.fact) == count(whole) and wh.fact.select("order_key").distinct().count() == whole.count()
    assert wh.fact.where("order_purchase_timestamp IS NULL").select("order_id").distinct().count() == orders.where("order_id % 10 = 3").count()
    assert wh.customers.where("customer_id IS NULL").count() == 1
    # the times arrive: the orders leave the null month and are there once
    wh = _loads(spark, str(tmp_path), (F.col("order_id") % 10 == 3,), customers=customers)
    assert count(wh.fact) == count(whole) and wh.fact.where("order_purchase_timestamp IS NULL").count() == 0


def test_a_load_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    from starloom.plans import warehouse as W
    path, odd = str(tmp_path), F.col("order_id") % 2 == 1
    before = sorted(_loads(spark, path, (odd,)).fact.select("order_key", "order_id").collect())
    with monkeypatch.context() as m:
        def die(*_):
            raise RuntimeError("lost between dimensions and fact")
        m.setattr(W, "fact_orders", die)
        with pytest.raises(RuntimeError, match="lost between"):
            _loads(spark, path, (~odd,))
    wh = W.read_warehouse(spark, path)
    assert sorted(wh.fact.select("order_key", "order_id").collect()) == before
    stale = W.snapshots.current(spark, path)
    _loads(spark, path, (~odd,))
    with pytest.raises(RuntimeError, match="committed first"):
        W.snapshots.commit(spark, path, stale)
    assert W.read_warehouse(spark, path).fact.count() == W.warehouse_from_testdata(spark, SF0001).fact.count()


def test_a_load_lets_go_of_finished_shuffles(spark, tmp_path, monkeypatch):
    """The files of the dimensions' shuffles are dropped before the fact is built, those of
    the fact's before the load goes on."""
    import os
    from starloom.plans import warehouse as W
    path, seen = str(tmp_path), []
    monkeypatch.setattr(W, "drop_finished_shuffles", lambda _: seen.append(sorted(os.listdir(path))))
    _loads(spark, path, (F.col("order_id") % 2 == 1,))
    dims = sorted(W.VIEW_NAMES[a] for a in W.DIMENSIONS)
    assert seen == [dims, sorted([*dims, "fact_orders"])]


def test_the_incremental_loads_do_not_cut_tables_that_the_fact_joins_to_its_orders(spark, monkeypatch):
    from starloom.queries import core
    found = []
    monkeypatch.setattr(core, "write_warehouse", lambda wh, _: found.append(wh))
    monkeypatch.delattr(core, "read_warehouse")
    with pytest.raises(NameError, match="read_warehouse"):
        core.q_warehouse_incremental(spark, SF0001)
    whole = core.warehouse_from_testdata(spark, SF0001).raw
    assert len(found) == 2 and all(getattr(wh.raw, t) is getattr(whole, t) for wh in found for t in ("items", "payments", "reviews"))
    sold = [{r.seller_id for r in wh.raw.sellers.collect()} for wh in found]
    early = found[0].raw
    assert sold[0] == {r.seller_id for r in whole.items.join(early.orders.select("order_id"), "order_id", "left_semi").select("seller_id").distinct().collect()}
