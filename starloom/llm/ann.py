"""Approximate nearest neighbours by balanced posting lists (cosine).

Fit.  A bounded sample (``SAMPLE`` distinct vectors, smallest hash of the id)
is clustered by k-means with a size penalty, so that lists are balanced.  A
neighbour graph over the centroids is kept in memory; all centroid searches go
through it, best first.

Index.  Every vector goes to its nearest list and, near a boundary, to the next
ones too (``closure`` x nearest distance, at most ``replicas`` lists, skipping
centroids closer to a chosen centroid than to the vector).

Search.  A query probes the lists whose centroid is within ``ratio`` x its
nearest centroid distance; the ratio is the smallest of a grid that reaches
``target`` recall on the sample against brute force (unbounded, i.e. all lists,
if none does).  Lists live in cells of ``CELL`` neighbouring lists, cells are
cut into blocks of bounded size; queries meet the blocks of their cells.

Equal vectors are one entry that carries its ``k + 1`` smallest ids, and equal
queries are searched once, so a vector held by a third of the rows costs no
more than another; no result is lost by it.  Scores are recomputed on the
original vectors in double precision, ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors of another than the commonest length, take no part;
fewer candidates than k are all returned; a query whose lists hold too few
rows is asked again in all lists, and so is an outlier at once; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import column
from .storage import materialise

SAMPLE = 16384
LISTS = 256
CELL = 8
BLOCK_ROWS = 65536
QUERY_ROWS = 16384
DEGREE = 16
OUTLIERS = 0.99         # share of the sample's vectors that are no outliers
RATIOS = (1.0, 1.01, 1.02, 1.03, 1.05, 1.07, 1.1, 1.15, 1.2, 1.3, 1.5, 2.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


@dataclass
class Index:
    centroids: np.ndarray      # unit vectors, neighbours in numbering
    graph: np.ndarray          # (lists, degree) neighbour ids
    entries: np.ndarray        # starting nodes of a search
    closure: float
    replicas: int
    ratio: float = np.inf
    far: float = np.inf        # nearest-centroid distance beyond which a query counts as an outlier

    def nearest(self, x: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the centroid graph for all rows of ``x`` at once:
        (visited and within ``ratio`` (rows, lists) bool, distances, inf where
        never visited).  A row
        ends when its best unexpanded node is beyond ``ratio`` x its nearest,
        or beyond the ``beam`` nearest found."""
        n, lists = len(x), len(self.centroids)
        distance = np.full((n, lists), np.inf)
        expanded = np.zeros((n, lists), bool)

        def visit(rows, nodes):
            cos = np.einsum("rd,rkd->rk", x[rows], self.centroids[nodes])
            distance[rows[:, None], nodes] = np.sqrt(np.maximum(2 - 2 * cos, 0))

        def reach(known):
            return known.min(axis=1) * ratio + 1e-12 if np.isfinite(ratio) else np.full(len(known), np.finfo(float).max)

        rows = np.arange(n)
        visit(rows, np.broadcast_to(self.entries, (n, len(self.entries))))
        while len(rows):
            open_ = np.where(expanded[rows], np.inf, distance[rows])
            best = open_.argmin(axis=1)
            value = open_[np.arange(len(rows)), best]
            known = distance[rows]
            limit = reach(known)
            if beam < lists:
                limit = np.minimum(limit, np.partition(known, beam - 1, axis=1)[:, beam - 1])
            # a row goes on while it has found less than a beam, or its next node is inside
            go = np.isfinite(value) & ((value <= limit) | (expanded[rows].sum(axis=1) < min(8, lists)))
            rows, best = rows[go], best[go]
            expanded[rows, best] = True
            if len(rows):
                visit(rows, self.graph[best])
        return distance <= reach(distance)[:, None], distance

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(rows, lists) bool: the lists a vector is stored in."""
        out = np.zeros((len(x), len(self.centroids)), bool)
        if not len(x):
            return out
        _, distance = self.nearest(x, np.inf, min(16, len(self.centroids)))
        order = np.argsort(distance, axis=1)[:, :4 * self.replicas]
        rows = np.arange(len(x))
        near = distance[rows, order[:, 0]]
        out[rows, order[:, 0]] = True
        between = np.sqrt(np.maximum(2 - 2 * self.centroids @ self.centroids.T, 0))
        for j in range(1, order.shape[1]):
            c = order[:, j]
            d = distance[rows, c]
            crowded = (np.where(out, between[c], np.inf).min(axis=1) < d)
            out[rows, c] |= (d <= self.closure * near) & ~crowded & (out.sum(axis=1) < self.replicas)
        return out

    def probe(self, x: np.ndarray) -> np.ndarray:
        """(rows, lists) bool: the lists a query looks into; all for outliers, which
        the calibrated ratio says nothing about."""
        if not np.isfinite(self.ratio):
            return self.everywhere(x)
        probed, distance = self.nearest(x, self.ratio, len(self.centroids))
        probed[distance.min(axis=1) > self.far] = True
        return probed

    def everywhere(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), len(self.centroids)), bool)


def fit(sample: np.ndarray, k: int = 5, target: float = 0.98, closure: float = 1.1, replicas: int = 2,
        lists: int = LISTS, rounds: int = 10) -> Index:
    """Index of unit vectors ``sample``; deterministic in its rows' order."""
    lists = max(1, min(lists, len(sample) // 32))
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    penalty = np.zeros(lists)
    for _ in range(rounds):
        assigned = (1 - sample @ centroids.T + penalty).argmin(axis=1)
        sizes = np.bincount(assigned, minlength=lists)
        penalty += 0.05 * (sizes / (len(sample) / lists) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, assigned, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    # neighbours in numbering: order along the main direction of the centroids
    axis = np.linalg.svd(centroids - centroids.mean(axis=0), full_matrices=False)[2][0]
    centroids = centroids[np.argsort(centroids @ axis, kind="stable")]
    similar = centroids @ centroids.T
    np.fill_diagonal(similar, -2)
    graph = np.argsort(-similar, axis=1, kind="stable")[:, :min(DEGREE, lists - 1)] if lists > 1 else np.zeros((1, 1), int)
    ring = np.stack([(np.arange(lists) + 1) % lists, (np.arange(lists) - 1) % lists], axis=1)  # keeps the graph connected
    index = Index(centroids, np.concatenate([graph, ring], axis=1),
                  np.unique(np.linspace(0, lists - 1, min(8, lists)).astype(int)), closure, replicas)

    asked = sample[:256]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    truth = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    stored = index.assign(sample)
    index.far = float(np.quantile(np.sqrt(np.maximum(2 - 2 * (sample @ centroids.T).max(axis=1), 0)), OUTLIERS))
    if truth.size:
        for ratio in RATIOS:
            probed, _ = index.nearest(asked, ratio, lists)
            recall = np.mean([(stored[t] & probed[i]).any(axis=1).mean() for i, t in enumerate(truth)])
            if recall >= target:
                index.ratio = ratio
                break
    return index


def _cells(member: np.ndarray):
    """(row, cell, bits of the lists in the cell) of a (rows, lists) table."""
    rows, lists = np.nonzero(member)
    cells = lists // CELL
    key = rows * (member.shape[1] // CELL + 1) + cells
    names, inverse = np.unique(key, return_inverse=True)
    bits = np.zeros(len(names), np.int64)
    np.add.at(bits, inverse, 1 << (lists % CELL))
    width = member.shape[1] // CELL + 1
    return names // width, names % width, bits


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           target: float = 0.98) -> DataFrame:
    """Each query's k nearest rows among ``vectors``, its own id left out:
    query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    first = Window.partitionBy("v").orderBy("id")
    entries = materialise(rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                          .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                          .select(F.col("ids")[0].alias("entry"), "ids", "v"), "vectors")
    head = entries.select("v").limit(1).collect()
    dim = len(head[0]["v"]) if head else 1
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim) if head else np.ones((1, 1))
    index = spark.sparkContext.broadcast(fit(_unit(sample), k, target))

    asked = usable(queries, id_col, vec_col).withColumnRenamed("id", "query_id")
    named = materialise(asked.join(entries.select("v", "entry"), "v", "left")
                        .select("query_id", "v", F.coalesce("entry", -F.col("query_id") - 1).alias("asked")), "queries")
    distinct = named.groupBy("asked").agg(F.min("v").alias("v"))

    def deal(name: str, payload: list[str], chosen):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    row, cell, bits = _cells(chosen(_unit(_matrix(column(part, "v"), dim))))
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bits), *[column(taken, c) for c in payload]],
                                                     names=["cell", "bits", *payload])
        return run

    stored = materialise(entries.mapInArrow(deal("entry", ["ids", "v"], lambda x: index.value.assign(x)),
                                            "cell long, bits long, ids array<long>, v array<double>"), "posting-lists")
    def meet(lists: pa.Table, probes: pa.Table) -> pa.Table:
        out = {"asked": [], "id": [], "score": []}
        if lists.num_rows and probes.num_rows:
            x, q = (_matrix(t.combine_chunks()[c].chunk(0), dim) for t, c in ((lists, "v"), (probes, "q")))
            norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            bits, q_bits = lists["bits"].to_numpy(), probes["q_bits"].to_numpy()
            asked_ids, ids = probes["asked"].to_pylist(), lists["ids"].to_pylist()
            ux, need = (x / norm_x[:, None]).T, min(k + 1, len(x))
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                cos = (q[part] / norm_q[part, None]) @ ux
                cos[(q_bits[part, None] & bits[None, :]) == 0] = -np.inf
                edge = np.partition(cos, len(x) - need, axis=1)[:, len(x) - need]
                for i in range(len(cos)):
                    near = np.flatnonzero((cos[i] >= edge[i] - 1e-9) & np.isfinite(cos[i]))
                    exact = (x[near] * q[lo + i]).sum(axis=1) / (norm_x[near] * norm_q[lo + i])
                    best = sorted((-s, v) for s, j in zip(exact.tolist(), near.tolist()) for v in ids[j])[:k + 1]
                    out["asked"] += [asked_ids[lo + i]] * len(best)
                    out["id"] += [v for _, v in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"asked": pa.array(out["asked"], pa.int64()), "id": pa.array(out["id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "id")

    def answers(wanted: DataFrame, chosen) -> DataFrame:
        """(asked, id, score): the k + 1 nearest in the lists that ``chosen`` picks."""
        sent = materialise(wanted.mapInArrow(deal("asked", ["asked", "v"], chosen), "cell long, bits long, asked long, v array<double>"), "probes")
        # bounded: one row per cell
        sizes = (stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("blocks"))
                 .join(sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("turns")), "cell"))
        sizes = F.broadcast(materialise(sizes, "cells"))
        left = (stored.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")))
                .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("blocks", "turns"))
        right = (sent.join(sizes, "cell").withColumn("turn", F.pmod(F.xxhash64("asked"), F.col("turns")))
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                 .select("cell", F.col("bits").alias("q_bits"), "asked", F.col("v").alias("q"), "block", "turn"))
        keys = ["cell", "block", "turn"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "asked long, id long, score double")
        return met.distinct().withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).drop("n")

    best = materialise(answers(distinct, lambda x: index.value.probe(x)), "answers")
    # queries whose lists held too few rows look into all
    enough = min(k + 1, rows.select("id").distinct().limit(k + 1).count())
    short = materialise(distinct.join(best.groupBy("asked").agg(F.count(F.lit(1)).alias("found")), "asked", "left")
                        .where(F.coalesce("found", F.lit(0)) < enough).select("asked", "v"), "short-queries")
    if not short.isEmpty():
        best = (best.join(short.select("asked"), "asked", "left_anti")
                .unionByName(answers(short, lambda x: index.value.everywhere(x))))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (named.select("query_id", "asked").distinct().join(best, "asked").withColumnRenamed("id", "vec_id")
            .where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
