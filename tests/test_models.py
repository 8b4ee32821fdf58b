"""Model properties (rows-only queries): sizes, bounds, probabilities."""

from pyspark.sql import functions as F

from conftest import SF0001


def test_segments_properties(queries, spark):
    seg = queries["customer_segments"](spark, SF0001)
    n = seg.count()
    sizes = queries["cluster_sizes"](spark, SF0001).collect()
    assert sum(r.customers for r in sizes) == n and len(sizes) == 4
    names = {r.segment for r in seg.select("segment").distinct().collect()}
    assert names == {"Frustrated Buyers", "Premium Buyers", "Mid-Value Buyers", "Standard Buyers"}
    summary = queries["segment_summary"](spark, SF0001).collect()
    frustrated = [r for r in summary if r.segment == "Frustrated Buyers"][0]
    assert frustrated.avg_review == min(r.avg_review for r in summary)


def test_forecast_bounds(queries, spark):
    fc = queries["sales_forecast"](spark, SF0001)
    rows = fc.collect()
    assert len(rows) == 30
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    s = queries["forecast_summary"](spark, SF0001).first()
    assert abs(s.total_revenue - sum(r.yhat for r in rows)) < 0.01 * max(1.0, abs(s.total_revenue))


def test_review_scoring_and_partial_inputs(spark):
    from starloom.models import review_classifier as RC
    from starloom.plans.warehouse import loaded_warehouse
    wh = loaded_warehouse(spark, SF0001)
    rows = RC.labelled_rows(wh, "tuned")
    model = RC.fit(rows, "tuned", {**RC.FIXED_SETTINGS, "max_depth": 3, "n_estimators": 5}, early_stopping=True)
    scored = RC.score(model, rows)
    r = scored.agg(F.min("good_review_prob").alias("lo"), F.max("good_review_prob").alias("hi"),
                   F.count(F.lit(1)).alias("n")).first()
    assert 0 <= r.lo <= r.hi <= 100 and r.n == rows.count()
    # serving-style request: only the seven numeric fields
    partial = rows.select(*RC.R.IDS, "price", "freight_value", "payment_value", "payment_installments",
                          "days_to_deliver", "days_estimated", "delivery_delay_days").limit(3)
    assert RC.score(model, partial).count() == 3
    # drop-first one-hot: one slot less than levels, and unseen levels are zero
    assert len(model.feature_names) == len(RC.TUNED_NUMERIC) + sum(len(v) - 1 for v in model.levels.values())
    unseen = rows.limit(1).withColumn("customer_state", F.lit("nowhere's"))
    at = {n: i for i, n in enumerate(model.feature_names)}
    other = rows.limit(1).withColumn("customer_state", F.lit(model.levels["customer_state"][0]))
    assert RC.probabilities(model, unseen).first().p == RC.probabilities(model, other).first().p
    assert any(n.startswith("customer_state_") for n in at)


def test_patience_rule():
    from starloom.models.boosting import patience_rule
    assert patience_rule([5, 4, 3, 3.5, 3.2, 3.1, 1], patience=3) == 3
    assert patience_rule([5, 4, 3, 2], patience=2) == 4 and patience_rule([1, 2, 3], patience=2) == 1


def test_search_refits_the_best_settings(spark):
    from starloom.models import review_classifier as RC
    from starloom.plans.warehouse import loaded_warehouse
    rows = RC.labelled_rows(loaded_warehouse(spark, SF0001), "tuned").cache()
    base = {**RC.FIXED_SETTINGS, "n_estimators": 3}
    model = RC.search_and_refit(rows, folds=2, combos=[{**base, "max_depth": 2}, {**base, "max_depth": 3}])
    ranked = RC.search(rows, folds=2, combos=[{**base, "max_depth": 2}, {**base, "max_depth": 3}]).collect()
    assert ranked[0].mean_f1 >= ranked[1].mean_f1 and f'"max_depth": {model.settings["max_depth"]}' in ranked[0].settings
    assert 1 <= model.settings["trees_kept"] <= 3
    cv = RC.cross_validate(rows, "tuned", {**base, "max_depth": 2}, folds=2).collect()
    assert len(cv) == 2 and all(0 <= r.f1 <= 1 for r in cv)


def test_new_customers_get_the_same_segments(spark):
    import tempfile
    from starloom.models import segments as S
    from starloom.operators.customers import customer_features
    from starloom.plans.warehouse import loaded_warehouse
    wh = loaded_warehouse(spark, SF0001)
    for log in (False, True):
        vecs, scaler = S.segment_vectors(wh, log=log)
        model = S.fit_kmeans(vecs, n_init=2)
        assigned = S.assign_segments(model, vecs)
        path = tempfile.mkdtemp(prefix="starloom-segments-")
        S.save(model, S.segment_names(assigned), scaler, path, log=log)
        feats = customer_features(wh, with_dates=False)
        ten = feats.orderBy("customer_id").limit(10)
        got = {r.customer_id: (r.cluster, r.segment) for r in S.score_customers(spark, path, ten).collect()}
        want = {r.customer_id: (r.cluster, r.segment) for r in assigned.collect()}
        assert len(got) == 10 and all(want[c] == v for c, v in got.items())


def test_sampled_silhouette_matches_brute_force(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from starloom.models.segments import silhouette_sample
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(5, 1, (30, 3)), rng.normal((0, 8, 0), 1, (1, 3))])
    lab = np.array([0] * 40 + [1] * 30 + [2])
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    schema = StructType([StructField("customer_id", LongType()), StructField("features", VectorUDT()),
                         StructField("cluster", IntegerType())])
    df = spark.createDataFrame([(i, Vectors.dense(p.tolist()), int(c)) for i, (p, c) in enumerate(zip(pts, lab))],
                               schema)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    s = []
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(silhouette_sample(df, sample_size=1000, block=16) - float(np.mean(s))) < 1e-12


def test_registered_classifier_queries_search_and_stop_early(spark, queries, monkeypatch):
    import json
    from starloom.models import review_classifier as RC
    from starloom.queries import models as M
    base = {**RC.FIXED_SETTINGS, "n_estimators": 2, "max_depth": 1}
    monkeypatch.setattr(M, "_MEMO", {})
    monkeypatch.setattr(RC, "FIXED_SETTINGS", base)
    monkeypatch.setattr(RC, "sample_grid", lambda n_iter: [base, {**base, "max_depth": 2}])
    ranked = queries["review_search"](spark, SF0001).collect()
    assert len(ranked) == 2 and ranked[0].mean_f1 >= ranked[1].mean_f1
    tuned = M._tuned(spark, SF0001).settings
    assert 1 <= tuned.pop("trees_kept") <= 2 and tuned == json.loads(ranked[0].settings)
    assert len(queries["review_cv"](spark, SF0001).collect()) == RC.CV_FOLDS


def test_elbow_silhouette_is_of_all_customers(spark, monkeypatch):
    """More customers than the sampled silhouette takes, in several records and parts."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from starloom.models import segments as S
    from starloom.models.lloyd import Clusters, Start, fit_starts
    monkeypatch.setattr(S, "SILHOUETTE_SAMPLE", 50)
    monkeypatch.setattr(S.picked_sample, "__defaults__", (50, 42))
    for name, size in (("BLOCK_POINTS", 60), ("PART_POINTS", 130), ("OWN_POINTS", 25), ("TILE_ROWS", 10), ("TILE", 16)):
        monkeypatch.setattr(S, name, size)
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(4, 1, (100, 3)), rng.normal((0, 9, 0), 2, (50, 3)), [[40.0, 40.0, 40.0]], np.zeros((2, 3))])
    vecs = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "customer_id long, x array<double>")
    vecs = vecs.select("customer_id", array_to_vector(F.col("x")).alias("features")).cache()

    def brute(lab):
        d, s = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)), []
        for i in range(len(pts)):
            own = lab == lab[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
            s.append((b - a) / max(a, b))
        return float(np.mean(s))

    rows = S.elbow(vecs, ks=(2, 4), n_init=2).collect()
    for r in rows:
        model = min(fit_starts(vecs, [Start(r.k, S.SEED), Start(r.k, S.SEED + 1)], S.MAX_ITER, S.TOL), key=lambda m: m.inertia)
        lab = np.array([q.cluster for q in model.transform(vecs).orderBy("customer_id").collect()])
        assert abs(r.silhouette - brute(lab)) < 1e-7
    # a cluster without customers is no neighbour, one cluster alone has no silhouette
    empty = Clusters(np.array([[0.0, 0.0, 0.0], [1e6, 0.0, 0.0]]), 0.0)
    assert S.silhouettes(vecs, [empty]) == [0.0] and [r.k for r in rows] == [2, 4]
