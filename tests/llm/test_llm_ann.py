import numpy as np
from pyspark.sql import functions as F

from starloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, entry string"


def brute(rows, k=5, asked=lambda i: True):
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows
            if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if asked(i):
            scored = sorted((-float((x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum()))), j) for j, x in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def rows_of(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(12)] + 0.4 * rng.normal(size=16))], "x") for i in range(n)]
    return rows + [(n + i, rows[0][1], "copy") for i in range(copies)]


def test_recall_and_exact_scores(spark):
    rows = rows_of(1500, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = results(ann.search(df, df.where("vec_id % 50 = 0")))
    truth = brute(rows, asked=lambda i: i % 50 == 0)
    assert set(got) == set(truth)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in truth[q]}) for q in truth)
    assert hits / (5 * len(truth)) >= 0.9
    exact = {q: dict(brute([r for r in rows if r[0] in (q, *[v for _, v, _ in got[q]])], asked=lambda i: i == q)[q]) for q in list(truth)[:10]}
    for q, scores in exact.items():
        assert [rank for rank, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(scores[v] == s for _, v, s in got[q])
        assert [v for _, v, _ in got[q]] == sorted(scores, key=lambda v: (-scores[v], v))


def test_copies_ties_and_bad_vectors(spark):
    rows = rows_of(40, 2, copies=60)
    rows += [(200, None, "x"), (201, [0.0] * 16, "x"), (202, [float("nan")] * 16, "x"), (203, [None] * 16, "x"), (204, [1.0, 2.0], "x"),
             (205, [float("inf")] + [1.0] * 15, "x"), (250, rows[3][1], "x"), (250, rows[3][1], "again")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = results(ann.search(df, df))
    truth = brute(list({r[0]: r for r in rows}.values()))
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in truth.items()}


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame(rows_of(3, 3), SCHEMA)
    got = results(ann.search(df, df))
    assert all(len(v) == 2 for v in got.values()) and len(got) == 3
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.limit(1), df.limit(1)).count() == 0


def test_graph_search_and_boundaries():
    rng = np.random.default_rng(4)
    x = ann._unit(rng.normal(size=(3000, 8)))
    index = ann.fit(x, lists=64)
    _, distance = index.nearest(x[:200], np.inf, 64)
    assert np.isfinite(distance).all()                      # the graph is connected
    stored = index.assign(x)
    assert stored.any(axis=1).all() and (stored.sum(axis=1) <= index.replicas).all() and (stored.sum(axis=1) > 1).any()
    nearest = (x @ index.centroids.T).argmax(axis=1)
    assert stored[np.arange(len(x)), nearest].mean() > 0.95
    sizes = stored.sum(axis=0)
    assert sizes.max() < 4 * sizes.mean()


def test_clusters_with_outliers_are_answered_whole(spark):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(40, 16))
    x = np.vstack([middles[i % 40] + rng.normal(0, 0.03, 16) for i in range(4000)] + [rng.normal(0, 1, 16) * 2 for _ in range(20)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [*range(0, 3000, 50), *range(4000, 4020)]
    got = {}
    for r in ann.search(df, df.where(F.col("vec_id").isin(asked))).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, outlier_hits = [], []
    for q in asked:
        cos = unit @ unit[q]
        cos[q] = -2
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        share = len(set(got[q].values()) & set(np.argsort(-cos)[:5].tolist())) / 5
        (outlier_hits if q >= 4000 else hits).append(share)
    assert np.mean(hits) >= 0.9 and np.mean(outlier_hits) >= 0.9
