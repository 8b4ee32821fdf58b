"""Driver contract."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields][:3] == ["year", "month", "month_name"]


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 40
