"""Operators on hand-made rows (FIXTURES.md part C) and their scale paths."""

import random

import numpy as np
from pyspark.sql import functions as F

from starloom.functions.stats import exact_median, prefix_sums
from starloom.operators.dedupe import keep_first
from starloom.operators.joins import left_join_expand
from starloom.operators.keys import with_surrogate_key
from starloom.operators.metrics import roc_auc, threshold_metrics
from starloom.operators.reviews import class_ranks


def test_keep_first_keeps_smallest_other_columns(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, None, "z"), (2, "c", "w")],
                               "id int, city string, state string")
    got = {r.id: (r.city, r.state) for r in keep_first(df, ["id"]).collect()}
    assert got == {1: ("a", "y"), 2: (None, "z")}  # NULL sorts first


def test_surrogate_key_paths_agree(spark):
    ids = list(range(0, 3000, 3))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    small = {r.id: r.k for r in with_surrogate_key(df, "k", ["id"], row_bound=len(ids)).collect()}
    large = {r.id: r.k for r in with_surrogate_key(df, "k", ["id"], row_bound=len(ids), local_limit=10,
                                                   num_partitions=7).collect()}
    assert small == large
    assert sorted(small.values()) == list(range(1, len(ids) + 1))
    assert small[0] == 1 and small[2997] == len(ids)


def test_left_join_expand_equals_left_join(spark, monkeypatch):
    import starloom.operators.joins as J
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (1, 11)] + [(2, i) for i in range(50)], "k int, w int")
    b = sorted(map(tuple, left.join(right, "k", "left").select("k", "v", "w").collect()), key=str)
    a = sorted(map(tuple, left_join_expand(left, right, "k", 52).select("k", "v", "w").collect()), key=str)
    assert a == b and len(a) == 53
    monkeypatch.setattr(J, "HOT_KEY_ROWS", 10)  # key 2 becomes hot: 5 salt buckets
    a = sorted(map(tuple, left_join_expand(left, right, "k", 52).select("k", "v", "w").collect()), key=str)
    assert a == b


def test_exact_median_matches_numpy_on_all_paths(spark):
    from starloom.functions import stats
    rng = np.random.default_rng(3)
    vals = list(rng.normal(100, 30, 2001)) + [42.0] * 700 + [None] * 5  # hot value + NULLs
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "x double")
    want = float(np.median([v for v in vals if v is not None]))
    assert exact_median(df, "x") == want
    old = stats.COLLECT_LIMIT
    try:
        stats.COLLECT_LIMIT = 10  # force histogram passes
        assert exact_median(df, "x") == want
        even = df.where(F.col("x") != 42.0)
        assert exact_median(even, "x") == float(np.median([v for v in vals if v is not None and v != 42.0]))
    finally:
        stats.COLLECT_LIMIT = old


def test_prefix_sums_paths_agree(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "s long, v long")
    a = {r.s: r.v_before for r in prefix_sums(df, ["s"], ["v"], row_bound=500).collect()}
    b = {r.s: r.v_before for r in prefix_sums(df, ["s"], ["v"], row_bound=500, local_limit=10,
                                              num_partitions=5).collect()}
    assert a == b and a[0] == 0 and a[499] == sum(i % 7 for i in range(499))


def test_roc_auc_equals_pair_count(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]  # many ties
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, p double")
    got = roc_auc(df, row_bound=300).first().roc_auc
    got_large = roc_auc(df, row_bound=10**9).first().roc_auc
    assert abs(got - want) < 1e-12 and abs(got_large - want) < 1e-12


def test_threshold_metrics_formulas(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.3), (0, 0.5), (0, 0.1)], "label int, p double")
    r = threshold_metrics(df, (0.4,)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    assert r.accuracy == 0.5 and r.precision == 0.5 and r.recall == 0.5 and r.f1 == 0.5


def test_class_ranks_balanced_folds(spark):
    rows = [(i, i % 3, i % 2) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "order_id long, product_key long, y int").withColumn("seller_key", F.lit(1))
    r = class_ranks(df, "y", row_bound=100)
    folds = r.groupBy("y", (F.col("class_rank") % 5).alias("f")).count().collect()
    sizes = {}
    for x in folds:
        sizes.setdefault(x.y, []).append(x["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())
    assert r.select("class_rank").distinct().count() == 50


def test_label_codes_paths_agree(spark, monkeypatch):
    import starloom.operators.reviews as R
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), ("a", "y")], "u string, v string")
    small = {(r.column_name, r.value): r.code for r in R.label_codes(df, ["u", "v"]).collect()}
    monkeypatch.setattr(R, "LOCAL_LIMIT", 0)
    monkeypatch.setattr("starloom.operators.keys.LOCAL_LIMIT", 0)
    large = {(r.column_name, r.value): r.code for r in R.label_codes(df, ["u", "v"]).collect()}
    assert small == large
    assert small == {("u", "a"): 0, ("u", "b"): 1, ("u", "c"): 2, ("v", "unknown"): 0, ("v", "x"): 1, ("v", "y"): 2}


def test_classification_report(spark):
    from starloom.operators.metrics import classification_report
    df = spark.createDataFrame([(1, 0.9), (1, 0.3), (0, 0.5), (0, 0.1), (0, 0.2)], "label int, p double")
    r = {x["class"]: x for x in classification_report(df, 0.4).collect()}
    assert (r["bad"].precision, r["bad"].recall, r["bad"].support) == (2 / 3, 2 / 3, 3)
    assert (r["good"].precision, r["good"].recall, r["good"].support) == (0.5, 0.5, 2)
    assert abs(r["weighted avg"].recall - 0.6) < 1e-12 and r["macro avg"].support == 5


def test_new_keys_follow_stored_ones(spark):
    from starloom.operators.keys import with_stored_keys
    stored = spark.createDataFrame([(1, "b"), (7, "d")], "k long, n string")
    new = with_stored_keys(spark.createDataFrame([(9, "a"), (9, "b"), (9, "c")], "k long, n string"), stored, "k", ["n"], ["n"], 3)
    assert sorted((r.k, r.n) for r in new.collect()) == [(8, "a"), (9, "c")]


def test_class_ranks_paths_agree(spark):
    rows = [(i, i % 7, i % 3, i % 2) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "order_id long, product_key long, seller_key long, y int")
    small = {r.order_id: (r.class_rank, r._class_rows) for r in class_ranks(df, "y", row_bound=300).collect()}
    from starloom.operators import keys
    old = keys.LOCAL_LIMIT
    import starloom.operators.reviews as R
    try:
        R.LOCAL_LIMIT = 10
        large = {r.order_id: (r.class_rank, r._class_rows) for r in
                 R.class_ranks(df, "y", row_bound=300).collect()}
    finally:
        R.LOCAL_LIMIT = old
    assert small == large
