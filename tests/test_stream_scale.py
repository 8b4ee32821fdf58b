"""A batch of very many orders joins the whole tables; a small one its own rows."""


def test_large_batch_joins_whole_tables(spark):
    from conftest import SF0001
    from starloom.operators.fact import fact_orders
    from starloom.plans.warehouse import Warehouse, raw_tables
    from starloom.streaming.incremental import batch_tables
    raw = raw_tables(spark, SF0001)
    orders = raw.orders.where("order_id % 3 = 0")
    facts = []
    for limit in (0, 10_000_000):
        part = batch_tables(raw, orders, orders.count(), limit)
        semi = part.items._jdf.queryExecution().executedPlan().toString()
        assert ("LeftSemi" in semi) == (limit > 0) and "SortMergeJoin" not in semi
        facts.append(sorted(map(str, fact_orders(part, Warehouse(raw)).collect())))
    assert facts[0] == facts[1] and facts[0]
