"""Plan shape: bounded sides broadcast, filters and columns pushed to scans."""

from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mart_pushes_status_filter_and_prunes_columns(queries, spark):
    p = plan(queries["monthly_sales"](spark, SF001))
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)" in p
    scan = [part for part in p.split("ReadSchema: ")[1:] if "order_status" in part.split("\n")[0]][0]
    read = scan.split("\n")[0]
    assert "payment_type" not in read and "customer_key" not in read


def test_dimension_joins_broadcast(queries, spark):
    p = plan(queries["sales_by_category"](spark, SF001))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_adhoc_sql_guard(spark):
    import pytest
    from starloom.plans.adhoc import check_select
    for good in ("SELECT 1;", "SELECT ';' AS x FROM dim_date", "WITH t AS (SELECT * FROM fact_orders) SELECT count(*) FROM t",
                 "SELECT * FROM dim_date WHERE date_key IN (SELECT order_date_key FROM fact_orders) LIMIT 3",
                 "SELECT a.state FROM vw_sales_by_state a JOIN dim_customers b ON a.state = b.customer_state"):
        assert check_select(spark, good) == good
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM y", "", "WITH t AS (SELECT 1 AS a) INSERT INTO fact_orders SELECT a FROM t",
                "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM other_table", "SELECT * FROM default.dim_date", "SHOW TABLES",
                "SELECT reflect('java.lang.System', 'getenv')", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`)",
                "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)", "CREATE VIEW v AS SELECT 1", "SET a=b"):
        with pytest.raises(ValueError):
            check_select(spark, bad)


def test_adhoc_sql_is_whole_or_flagged(spark):
    from starloom.plans.adhoc import adhoc_sql
    from starloom.plans.warehouse import loaded_warehouse
    wh = loaded_warehouse(spark, SF001)
    whole = adhoc_sql(spark, wh, "SELECT order_id FROM fact_orders")
    assert whole.count() == wh.fact.count()
    capped = adhoc_sql(spark, wh, "SELECT order_id FROM fact_orders", cap=7).collect()
    assert len(capped) == 7 and all(r.truncated for r in capped)
    assert not adhoc_sql(spark, wh, "SELECT 1 AS a", cap=7).first().truncated


def test_fact_plan_at_scale(spark, monkeypatch):
    """Broadcasts off (the shape at 100 TB): dimension lookups become shuffle
    joins, every source is scanned once per use (lineitem: items, payments and
    reviews), and the expansion is the plain left join."""
    import starloom.operators.joins as J
    from starloom.plans.warehouse import warehouse_from_testdata
    monkeypatch.setattr(J, "BROADCAST_ROW_LIMIT", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(warehouse_from_testdata(spark, SF001).fact)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert p.count("lineitem.parquet") == 3 and p.count("partial_sum(payment_value") == 1
    assert "SortMergeJoin [customer_id" in p and "SortMergeJoin [product_id" in p
    assert "_salt" not in p


def test_categorical_lookups_and_auc_at_scale(spark, monkeypatch):
    """Limits at 0: nothing is shuffled on a categorical column, and no window
    holds all rows."""
    import starloom.functions.stats as stats
    from starloom.operators import metrics
    from starloom.operators import reviews as R
    from starloom.plans.warehouse import loaded_warehouse
    wh = loaded_warehouse(spark, SF001)
    complete = plan(R.review_features_complete(wh))
    assert not any(f"hashpartitioning({c}" in complete for c in R.CATEGORICAL)
    monkeypatch.setattr(stats, "LOCAL_LIMIT", 0)
    scores = spark.range(1000).selectExpr("cast(id % 2 as int) as label", "id / 1000 as p")
    assert abs(metrics.roc_auc(scores, row_bound=1000).first().roc_auc - 0.501) < 1e-9


def test_schema_catalog_lists_views_and_tables(spark):
    from starloom.plans.adhoc import schema_catalog
    from starloom.plans.warehouse import loaded_warehouse
    cat = {(r.object_name, r.column_name) for r in schema_catalog(spark, loaded_warehouse(spark, SF001)).collect()}
    assert ("vw_sales_by_category", "category") in cat
    assert ("fact_orders", "order_key") in cat and ("dim_date", "is_weekend") in cat
