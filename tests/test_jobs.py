"""Batch jobs over a written warehouse (no raw sources at read time)."""

import tempfile

from conftest import SF0001


def test_load_query_segments(spark, capsys):
    from starloom import jobs
    base = tempfile.mkdtemp(prefix="starloom-jobs-")
    jobs.main(["load", "--tables", SF0001, "--warehouse", f"{base}/wh"])
    jobs.main(["query", "--warehouse", f"{base}/wh", "--sql",
               "SELECT state, total_orders FROM vw_sales_by_state ORDER BY total_orders DESC LIMIT 2"])
    lines = [l for l in capsys.readouterr().out.splitlines() if l.startswith("{")]
    assert len(lines) == 2
    jobs.main(["segments", "--warehouse", f"{base}/wh", "--out", f"{base}/seg", "--n-init", "2"])
    assert spark.read.parquet(f"{base}/seg/summary").count() == 4
