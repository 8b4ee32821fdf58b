"""Batch jobs, runnable with ``spark-submit`` or ``python -m starloom.jobs``.

    load      raw sources (CSV folder or driver tables) -> warehouse folder
    segments  fit customer segments on a warehouse, save model, write assignments
    reviews   fit a review classifier variant, save it, write test metrics
    forecast  fit the revenue forecast, write the next N days
    query     run one guarded SELECT over the warehouse views, print JSON rows

The session comes from ``spark-submit`` / the cluster defaults; outputs go
to the given folders (shared storage on a cluster).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.adhoc import adhoc_sql
from .plans.warehouse import Warehouse, read_warehouse, write_warehouse
from .sources.csv import FILES, MULTI_LINE, malformed_rows, raw_from_csv
from .sources.raw import raw_from_testdata


def _session() -> SparkSession:
    from .session import SCALE_CONF
    builder = SparkSession.builder.appName("starloom")
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cmd_load(spark, a):
    raw = raw_from_csv(spark, a.csv) if a.csv else raw_from_testdata(spark, a.tables)
    write_warehouse(Warehouse(raw), a.warehouse)
    if a.csv:
        for name, file in FILES.items():
            r = malformed_rows(spark, f"{a.csv.rstrip('/')}/{file}", multi_line=name in MULTI_LINE).first()
            print(json.dumps({"file": file, "rows": r["rows"], "malformed_rows": r["malformed_rows"]}))


def cmd_segments(spark, a):
    from .models import segments as S
    wh = read_warehouse(spark, a.warehouse)
    vecs, scaler = S.segment_vectors(wh, min_orders=a.min_orders, log=a.log)
    model = S.fit_kmeans(vecs, k=a.k, n_init=a.n_init)
    assigned = S.assign_segments(model, vecs)
    S.save(model, S.segment_names(assigned), scaler, f"{a.out}/model", log=a.log)
    assigned.select("customer_id", "cluster", "segment").write.mode("overwrite").parquet(f"{a.out}/assignments")
    S.segment_summary(assigned).write.mode("overwrite").parquet(f"{a.out}/summary")


def cmd_reviews(spark, a):
    from .models import review_classifier as RC
    wh = read_warehouse(spark, a.warehouse)
    rows = RC.labelled_rows(wh, a.variant).cache()
    if a.variant == "tuned" and a.search:
        model = RC.search_and_refit(rows)
    else:
        model = RC.fit(rows, a.variant, RC.FIXED_SETTINGS, early_stopping=(a.variant == "tuned"))
    RC.save(model, f"{a.out}/model")
    RC.evaluate(model, rows, wh.bound("items")).write.mode("overwrite").parquet(f"{a.out}/metrics")


def cmd_forecast(spark, a):
    from .models import forecast as FC
    FC.forecast(read_warehouse(spark, a.warehouse), a.days).write.mode("overwrite").parquet(a.out)


def cmd_query(spark, a):
    rows = adhoc_sql(spark, read_warehouse(spark, a.warehouse), a.sql, a.cap)
    for row in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator():
        print(row[0])


def main(argv=None):
    p = argparse.ArgumentParser(prog="starloom.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("load")
    src = s.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the marketplace CSV files")
    src.add_argument("--tables", help="folder with the driver's parquet tables")
    s.add_argument("--warehouse", required=True)
    s = sub.add_parser("segments")
    s.add_argument("--warehouse", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--k", type=int, default=4)
    s.add_argument("--n-init", type=int, default=10)
    s.add_argument("--min-orders", type=int, default=1)
    s.add_argument("--log", action="store_true", help="log1p the spend features")
    s = sub.add_parser("reviews")
    s.add_argument("--warehouse", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--variant", choices=["tuned", "fixed"], default="tuned")
    s.add_argument("--search", action="store_true", help="random search before the final fit")
    s = sub.add_parser("forecast")
    s.add_argument("--warehouse", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--days", type=int, default=30)
    s = sub.add_parser("query")
    s.add_argument("--warehouse", required=True)
    s.add_argument("--sql", required=True)
    s.add_argument("--cap", type=int, help="rows at most; a truncated flag tells whether there were more")
    a = p.parse_args(argv)
    spark = _session()
    {"load": cmd_load, "segments": cmd_segments, "reviews": cmd_reviews, "forecast": cmd_forecast,
     "query": cmd_query}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
