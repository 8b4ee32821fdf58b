"""Model queries (rows-only checks: fits and iterative algorithms).

Fitted models are memoised per session and data folder, so the queries
that read one model (segments, summaries, profiles, PCA) fit it once.
The fixed classifier uses the full settings (300 trees of depth 6), the tuned
one the best of the whole random search, fitted again with early stopping; the
search runs once for all queries that need it.
"""

from __future__ import annotations

import threading
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import forecast as FC
from ..models import review_classifier as RC
from ..models import segments as S
from ..models.lloyd import Clusters
from ..operators import reviews as R
from ..operators.customers import SEGMENT_FEATURES, customer_features
from ..plans.catalog import register
from ..plans.oracle import oracle
from ..plans.warehouse import DIMENSIONS, VIEW_NAMES, loaded_warehouse, read_warehouse, write_warehouse
from ..session import ensure_checkpoint_dir
from .features import CF_CTE, REVIEW_BASE_CTE, scaled_sql

_MEMO: dict = {}
_LOCK = threading.RLock()


def _memo(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = build()
        return _MEMO[key]


def _segments(spark, sf_dir):
    def build():
        wh = loaded_warehouse(spark, sf_dir)
        vecs, scaler = S.segment_vectors(wh)
        model = S.fit_kmeans(vecs)
        return vecs, model, S.assign_segments(model, vecs).cache(), scaler
    return _memo(spark, sf_dir, "segments", build)


# --------------------------------------------------------------- segments

@register("customer_segments")
def q_customer_segments(spark, sf_dir):
    assigned = _segments(spark, sf_dir)[2]
    return assigned.select("customer_id", "cluster", "segment")


@register("segment_summary")
def q_segment_summary(spark, sf_dir):
    """Serving path: persist model + scaler, load them back, assign every
    customer, summarise per segment."""
    _, model, assigned, scaler = _segments(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/starloom-segments-{uuid.uuid4().hex}"
    S.save(model, S.segment_names(assigned), scaler, path)
    feats = customer_features(loaded_warehouse(spark, sf_dir), with_dates=False)
    return S.segment_summary(S.score_customers(spark, path, feats))


# Centres in standardised features, for the arithmetic after a fit.
GIVEN_CENTERS = [[0.0] * 10, [1.0] * 10, [-1.0] * 10, [1.0, -1.0] * 5]


def _given_cte() -> str:
    """Customers with the nearest given centre, and its name by rank."""
    far = "[" + ", ".join(
        " + ".join(f"power(z.{f} - ({v}), 2)" for f, v in zip(SEGMENT_FEATURES, c)) for c in GIVEN_CENTERS) + "]"
    return f"""{CF_CTE},
z AS ({scaled_sql()}),
far AS (SELECT customer_id, {far} AS d FROM z),
assigned AS (SELECT cf.*, CAST(list_position(d, list_min(d)) - 1 AS INT) AS cluster FROM cf JOIN far USING (customer_id)),
ranks AS (SELECT cluster, avg(avg_review_score) AS review, avg(total_spent) AS spend FROM assigned GROUP BY cluster),
lowest AS (SELECT cluster FROM ranks ORDER BY review, cluster LIMIT 1),
names AS (
  SELECT cluster, CASE WHEN cluster = (FROM lowest) THEN '{S.FRUSTRATED}'
         ELSE ({S.BY_SPEND})[row_number() OVER (PARTITION BY cluster = (FROM lowest) ORDER BY spend DESC, cluster)] END AS segment
  FROM ranks)"""


def _given(spark, sf_dir):
    """Customers under the given centres, assigned and named like a fitted model's."""
    def build():
        vecs = S.segment_vectors(loaded_warehouse(spark, sf_dir))[0]
        return S.assign_segments(Clusters(np.array(GIVEN_CENTERS), 0.0), vecs).cache()
    return _memo(spark, sf_dir, "segments-given", build)


@register("segment_summary_given", oracle("""
SELECT cluster, segment, count(*) AS customer_count, round(avg(total_spent), 2) AS avg_spent, round(avg(avg_review_score), 2) AS avg_review,
       round(avg(avg_delivery_days), 2) AS avg_delivery
FROM assigned JOIN names USING (cluster) GROUP BY cluster, segment""", _given_cte()))
def q_segment_summary_given(spark, sf_dir):
    return S.segment_summary(_given(spark, sf_dir))


@register("cluster_sizes_given", oracle("""
SELECT cluster, count(*) AS customers, round(count(*) * 100.0 / (SELECT count(*) FROM assigned), 1) AS pct FROM assigned GROUP BY cluster""", _given_cte()))
def q_cluster_sizes_given(spark, sf_dir):
    return S.cluster_sizes(_given(spark, sf_dir))


@register("cluster_profile_given", oracle(
    f"SELECT *, {', '.join(f'({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}_norm' for c in SEGMENT_FEATURES)} FROM means",
    _given_cte() + f""",
means AS (SELECT cluster, {', '.join(f'round(avg({c}), 2) AS {c}' for c in SEGMENT_FEATURES)} FROM assigned GROUP BY cluster)"""))
def q_cluster_profile_given(spark, sf_dir):
    return S.cluster_profile(_given(spark, sf_dir))


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return S.cluster_sizes(_segments(spark, sf_dir)[2])


@register("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    return S.cluster_profile(_segments(spark, sf_dir)[2])


@register("silhouette")
def q_silhouette(spark, sf_dir):
    """Euclidean silhouette on a 10,000-customer sample (the reference's
    measure) and the squared-Euclidean silhouette over all customers."""
    _, model, assigned, _ = _segments(spark, sf_dir)
    sample = S.silhouette_sample(assigned)
    full = S.silhouette(assigned)
    return spark.createDataFrame(
        [(len(model.centers), float(sample), float(full), float(model.inertia))],
        "k int, silhouette double, silhouette_sq_euclidean_all double, inertia double")


@register("kmeans_elbow")
def q_kmeans_elbow(spark, sf_dir):
    return S.elbow(_segments(spark, sf_dir)[0])


@register("customer_pca")
def q_customer_pca(spark, sf_dir):
    return S.customer_pca(_segments(spark, sf_dir)[2])


# ------------------------------------------------------ review classifier

def _rows(spark, sf_dir, variant):
    return _memo(spark, sf_dir, f"rows-{variant}",
                 lambda: RC.labelled_rows(loaded_warehouse(spark, sf_dir), variant).cache())


def _search(spark, sf_dir):
    return _memo(spark, sf_dir, "review-search", lambda: RC.search(_rows(spark, sf_dir, "tuned")))


def _tuned(spark, sf_dir):
    """The tuned model: the best settings of the whole search, refitted."""
    return _memo(spark, sf_dir, "review-tuned", lambda: RC.refit(_rows(spark, sf_dir, "tuned"), _search(spark, sf_dir)))


def _onehot_sql(c):
    """0/1 digits, one per sorted level but the first."""
    levels = f"(SELECT DISTINCT COALESCE({c}, 'unknown') AS v FROM base)"
    return (f"(SELECT string_agg(CASE WHEN v = COALESCE(b.{c}, 'unknown') THEN '1' ELSE '0' END, '' ORDER BY v) "
            f"FROM {levels} WHERE v > (SELECT min(v) FROM {levels})) AS {c}_onehot")


@register("review_onehot", oracle(
    f"SELECT order_id, product_key, seller_key, {', '.join(map(_onehot_sql, R.CATEGORICAL))} FROM base b", REVIEW_BASE_CTE))
def q_review_onehot(spark, sf_dir):
    """Drop-first indicators of the tuned variant's categoricals, as one digit
    per level."""
    rows = R.review_features(loaded_warehouse(spark, sf_dir), median_price=0.0)
    sql = RC.indicator_columns(RC.category_levels(rows))
    return rows.select(*R.IDS, *[F.expr("concat(''" + "".join(f", CAST(CAST({x} AS INT) AS STRING)" for x in sql[c]) + ")").alias(f"{c}_onehot")
                                 for c in R.CATEGORICAL])


@register("review_model_metrics")
def q_review_model_metrics(spark, sf_dir):
    bound = loaded_warehouse(spark, sf_dir).bound("items")
    models = {"tuned": _tuned(spark, sf_dir), "fixed": RC.fit(_rows(spark, sf_dir, "fixed"), "fixed", RC.FIXED_SETTINGS)}
    return reduce(DataFrame.unionByName, [RC.evaluate(m, _rows(spark, sf_dir, v), bound) for v, m in models.items()])


@register("review_search")
def q_review_search(spark, sf_dir):
    return _search(spark, sf_dir)


@register("review_cv")
def q_review_cv(spark, sf_dir):
    return RC.cross_validate(_rows(spark, sf_dir, "fixed"), "fixed", RC.FIXED_SETTINGS)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    return RC.importance(_tuned(spark, sf_dir), 15)


@register("score_reviews")
def q_score_reviews(spark, sf_dir):
    """Batch scoring with the persisted model (saved, then loaded back)."""
    path = f"{ensure_checkpoint_dir(spark)}/starloom-review-model-{uuid.uuid4().hex}"
    RC.save(_tuned(spark, sf_dir), path)
    model = RC.load(spark, path)
    return RC.score(model, _rows(spark, sf_dir, "tuned"))


# --------------------------------------------------------------- forecast

def _forecast(spark, sf_dir):
    return _memo(spark, sf_dir, "forecast", lambda: FC.forecast(loaded_warehouse(spark, sf_dir), 30).cache())


@register("sales_forecast")
def q_sales_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir)


@register("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    return FC.summary(_forecast(spark, sf_dir))


@register("forecast_components")
def q_forecast_components(spark, sf_dir):
    return FC.components(loaded_warehouse(spark, sf_dir))


@register("forecast_model_error")
def q_forecast_model_error(spark, sf_dir):
    return FC.holdout_error(loaded_warehouse(spark, sf_dir))


# ------------------------------------------------------------ persistence

@register("warehouse_roundtrip", oracle("\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in
    ("dim_customers", "dim_sellers", "dim_products", "dim_date", "dim_geolocation", "fact_orders"))))
def q_warehouse_roundtrip(spark, sf_dir):
    """Write the loaded star schema twice to one folder (idempotent: the
    second write replaces, never appends) and count rows per table read back."""
    wh = loaded_warehouse(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/starloom-roundtrip-{uuid.uuid4().hex}"
    write_warehouse(wh, path)
    write_warehouse(wh, path)
    back = read_warehouse(spark, path, wh.raw)
    frames = [getattr(back, a).select(F.lit(VIEW_NAMES[a]).alias("table_name")) for a in (*DIMENSIONS, "fact")]
    u = frames[0]
    for fr in frames[1:]:
        u = u.unionByName(fr)
    return u.groupBy("table_name").agg(F.count(F.lit(1)).alias("rows"))


# -------------------------------------------------------------- streaming

@register("fact_orders_streamed", oracle("SELECT * FROM fact_orders"))
def q_fact_orders_streamed(spark, sf_dir):
    """The fact built by the micro-batch loader from the orders file stream."""
    from ..streaming.incremental import load_orders_incrementally
    from ..plans.warehouse import warehouse_from_testdata
    base = f"{ensure_checkpoint_dir(spark)}/starloom-stream-{uuid.uuid4().hex}"
    return load_orders_incrementally(spark, warehouse_from_testdata(spark, sf_dir), sf_dir,
                                     f"{base}/out", f"{base}/state", pattern="orders.parquet")
