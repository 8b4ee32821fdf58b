"""Spelling variants: k-d trees over letter-count vectors.

Words are maximal runs of Latin letters (A-Z lower-cased); counting them combines
map-side.  Two words are near when they differ by exactly one inserted,
deleted or replaced code point.  One edit moves the vector of letter counts by an
L1 distance of 1 (length changes) or 2 (it stays), so near words are found by range
searches: for each pair of lengths (L, L) with radius 2, and (L, L + 1) with
radius 1, every box of a k-d tree that is farther away is pruned, and the letter
order of what is left is verified.

The upper part of each length's tree is fitted on a bounded sample of words
(``SAMPLE``); its leaves are cells of about ``CELL`` words.  Every word is indexed in its
cell and sent as a query to each cell whose box lies within the radius; the lower
part of the tree is built inside the cell.  A cell that holds more words than planned
is cut into blocks by a hash of the word, each asked by all of the cell's queries, so
that no task holds an unbounded cell; the sample decides speed, never results.

A word's form is its near word of largest count (ties: smallest in code-point
order) if that count is at least ``ratio`` times its own.  Counts grow by that
factor along forms, so roots are found by pointer doubling in a few rounds.

Defined results: null and empty texts have no words; a null id stands as an
empty string in the hash that plants typos (``occurrences``); repeated rows count
each time; very long runs are words like any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import column
from .storage import discard, materialise

RUN = "[A-Za-z\\u00C0-\\u00FF]"
SAMPLE = 200_000        # words that the upper trees are fitted on, at most
CELL = 2048             # words of a cell, about
BLOCK = 4 * CELL        # words that one task indexes at once, at most about
LEAF = 24               # words of a leaf of the lower tree
PAIRS = 400_000         # candidate pairs verified at once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters of lower-cased runs: a-z, then U+00C0 to U+00FF.
_SLOT = np.full(256, -1, np.int64)
_SLOT[97:123] = np.arange(26)
_SLOT[0xC0:0x100] = 26 + np.arange(64)
LETTERS = 90


def occurrences(docs: DataFrame, min_length: int, modulus: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every run of at least ``min_length`` code points.  Where
    ``modulus`` divides the crc32 h of ``<id>:<run>``, the run loses its code point
    h % length; what then is too short is left out."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0)))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    lowered = found.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = lowered.select("run", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    return hashed.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, **names) -> DataFrame:
    """(word, n) of every word seen at least ``min_count`` times."""
    return occurrences(docs, min_length, **names).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def letter_codes(words: list[str]) -> np.ndarray:
    """Letter slots of equally long words, one row a word."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return _SLOT[data].astype(np.int16)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Vectors of letter counts, one row a word."""
    n = len(codes)
    flat = (np.arange(n)[:, None] * LETTERS + codes).ravel()
    return np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """Axis and threshold (left: count <= threshold) that halve the vectors
    best; None where all are equal."""
    best = None
    for axis in np.argsort(-counts.var(0), kind="stable")[:6].tolist():
        values, sizes = np.unique(counts[:, axis], return_counts=True)
        if len(values) > 1:
            left = np.cumsum(sizes)[:-1]
            at = int(np.argmin(np.abs(2 * left - len(counts))))
            score = abs(2 * int(left[at]) - len(counts))
            if best is None or score < best[0]:
                best = (score, axis, int(values[at]))
    return best and best[1:]


class UpperTree:
    """Splits of one length, fitted on a sample; leaves are numbered cells."""

    def __init__(self, counts: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []     # axis, threshold, left, right; or -1, cell, 0, 0
        self.cells = 0
        self._grow(counts, cells)

    def _grow(self, counts: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, self.cells, 0, 0))
        split = _split(counts) if cells > 1 and len(counts) > 1 else None
        if split is None:
            self.cells += 1
            return me
        left = counts[:, split[0]] <= split[1]
        a, b = self._grow(counts[left], cells // 2), self._grow(counts[~left], cells - cells // 2)
        self.nodes[me] = (*split, a, b)
        return me

    def reach(self, counts: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows, home) of every cell whose box is within ``radius`` of the rows'
        vectors; ``home`` marks the rows that lie in the box."""
        # the L1 distance to a box is a sum over axes, so the gap already paid on each axis is kept
        todo = [(0, np.arange(len(counts)), np.zeros((len(counts), 0), np.int32), {})]
        while todo:
            node, rows, gaps, axes = todo.pop()
            axis, threshold, left, right = self.nodes[node]
            if axis < 0:
                yield threshold, rows, gaps.sum(1) == 0 if gaps.shape[1] else np.ones(len(rows), bool)
                continue
            if axis not in axes:
                axes = {**axes, axis: gaps.shape[1]}
                gaps = np.hstack([gaps, np.zeros((len(rows), 1), np.int32)])
            at, value = axes[axis], counts[rows, axis]
            for child, gap in ((left, value - threshold), (right, threshold + 1 - value)):
                new = gaps.copy()
                new[:, at] = np.maximum(new[:, at], gap)
                keep = new.sum(1) <= radius
                if keep.any():
                    todo.append((child, rows[keep], new[keep], axes))


def _near_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether equally long code rows differ in exactly one place."""
    return (a != b).sum(1) == 1


def _near_longer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b``, longer by one, is ``a`` with one code point inserted."""
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


def range_search(queries: np.ndarray, words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, word) of letter-code rows whose count vectors are exactly
    ``radius`` apart, by a k-d tree over the words."""
    q_counts, w_counts = letter_counts(queries), letter_counts(words)
    used = np.flatnonzero(w_counts.any(0) | q_counts.any(0))
    q_counts, w_counts = q_counts[:, used], w_counts[:, used]

    def leaf(rows, asked):
        step = max(1, PAIRS // (len(rows) * max(1, len(used) // 8)))
        for at in range(0, len(asked), step):
            part = asked[at:at + step]
            distance = np.abs(q_counts[part][:, None] - w_counts[rows][None]).sum(2)
            q, w = np.nonzero(distance == radius)
            yield part[q], rows[w]

    todo = [(np.arange(len(words)), np.arange(len(queries)))]
    while todo:
        rows, asked = todo.pop()
        # the tight box of the node's words prunes more than its splitting planes
        low, high = w_counts[rows].min(0), w_counts[rows].max(0)
        mine = q_counts[asked]
        asked = asked[(np.maximum(low - mine, 0) + np.maximum(mine - high, 0)).sum(1) <= radius]
        if not len(asked):
            continue
        split = _split(w_counts[rows]) if len(rows) > LEAF else None
        if split is None:
            yield from leaf(rows, asked)
        else:
            left = w_counts[rows, split[0]] <= split[1]
            todo += [(rows[left], asked), (rows[~left], asked)]


def near_pairs(queries: list[str], words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart; all queries are equally long, and all
    words are as long or longer by one.  Equally long pairs come once, with query < word."""
    q_codes, w_codes = letter_codes(queries), letter_codes(words)
    longer = w_codes.shape[1] - q_codes.shape[1]
    # numpy compares the code rows' order only where it must: candidates are few
    for q, w in range_search(q_codes, w_codes, 1 if longer else 2):
        for at in range(0, len(q), PAIRS):
            a, b = q[at:at + PAIRS], w[at:at + PAIRS]
            ok = (_near_longer if longer else _near_equal)(q_codes[a], w_codes[b])
            if not longer and ok.any():
                a, b, ok = a[ok], b[ok], np.ones(int(ok.sum()), bool)
                x, y = q_codes[a], w_codes[b]
                first = (x != y).argmax(1)
                ok = x[np.arange(len(a)), first] < y[np.arange(len(a)), first]
            yield a[ok], b[ok]


def _fit(words: DataFrame, cell: int) -> dict[int, UpperTree]:
    """One upper tree per length, on a bounded sample."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    sample = words.select("word")
    if total > SAMPLE:
        sample = sample.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((1 << 20) * 0.9 * SAMPLE / total)).limit(SAMPLE)
    drawn: dict[int, list[str]] = {}
    for r in sample.collect():
        drawn.setdefault(len(r["word"]), []).append(r["word"])
    empty = np.zeros((0, LETTERS), np.int32)
    return {length: UpperTree(letter_counts(letter_codes(sorted(drawn[length]))) if length in drawn else empty, -(-n // cell))
            for length, n in sizes.items()}


def _routed(words: DataFrame, trees: dict[int, UpperTree]) -> DataFrame:
    """(length, cell, asks, word, n): each word once as indexed (asks false), and as a
    query in every cell within reach, of its own length and of the next."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def route(batches):
        for batch in batches:
            frame = pd.DataFrame({"word": column(batch, "word").to_pylist(), "n": column(batch, "n").to_pylist()})
            for length, part in frame.groupby(frame["word"].str.len()):
                names, n = part["word"].to_numpy(object), part["n"].to_numpy(np.int64)
                counts = letter_counts(letter_codes(names.tolist()))
                for longer in (0, 1):
                    tree = shared.value.get(int(length) + longer)
                    if tree is None:
                        continue
                    for cell, rows, home in tree.reach(counts, 1 if longer else 2):
                        for asks, picked in ((True, rows), (False, rows[home] if not longer else rows[:0])):
                            if len(picked):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(picked), int(length) + longer), pa.int32()), pa.array(np.full(len(picked), cell), pa.int32()),
                                     pa.array(np.full(len(picked), asks)), pa.array(names[picked], pa.string()), pa.array(n[picked], pa.int64())],
                                    names=["length", "cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "length int, cell int, asks boolean, word string, n long")


def near_words(words: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of every word of (word, n) that has near
    words: their number, and the one of largest count.  ``words`` should be a
    stored table."""
    routed = materialise(_routed(words, _fit(words, cell)), "spelling-cells")
    # cells beyond their planned size are cut: indexed words dealt to blocks, queries sent to all
    full = routed.groupBy("length", "cell").agg(F.count_if(~F.col("asks")).alias("size"), F.count_if("asks").alias("asked"))
    cut = full.select("length", "cell", F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.ceil(F.col("asked") / (8 * block)).cast("int").alias("lots"))
    # one row a cell: a cell holds some thousand words, so this is a small part of the words
    sized = routed.join(cut, ["length", "cell"])

    def slots(count: Column, dealt: Column, seed: int) -> Column:
        mine = F.pmod(F.xxhash64("word", F.lit(seed)), count).cast("int")
        return F.explode(F.when(dealt, F.array(mine)).otherwise(F.sequence(F.lit(0), count - 1)))

    dealt = (sized.where("blocks > 0").select("*", slots(F.col("blocks"), ~F.col("asks"), 1).alias("block"))
             .where("lots > 0").select("length", "cell", "block", "asks", "word", "n", slots(F.col("lots"), F.col("asks"), 2).alias("lot")))

    def search(table: pa.Table) -> pa.Table:
        names, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
        asks = table["asks"].to_numpy()
        held, held_n = names[~asks], n[~asks]
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        words, near, near_n = [held[:0]], [held[:0]], [held_n[:0]]
        for length in np.unique(lengths[asks]).tolist() if len(held) else ():
            mine = asks & (lengths == length)
            asked, asked_n = names[mine], n[mine]
            for q, w in near_pairs(asked.tolist(), held.tolist()):
                words += [asked[q], held[w]]
                near += [held[w], asked[q]]
                near_n += [held_n[w], asked_n[q]]
        pairs = pd.DataFrame({"word": np.concatenate(words), "near_n": np.concatenate(near_n), "near": np.concatenate(near)})
        pairs = pairs.sort_values(["word", "near_n", "near"], ascending=[True, False, True], kind="stable")
        best = pairs.drop_duplicates("word")
        sizes = pairs.groupby("word").size().reindex(best["word"]).to_numpy(np.int64)
        return pa.table([pa.array(best["word"].tolist(), pa.string()), pa.array(sizes, pa.int64()),
                         pa.array(best["near_n"].to_numpy(np.int64)), pa.array(best["near"].tolist(), pa.string())], names=["word", "n_near", "near_n", "near"])

    partial = dealt.groupBy("length", "cell", "block", "lot").applyInArrow(search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def variant_groups(words: DataFrame, ratio: int = 5, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    near = near_words(words, cell, block)
    formed = F.col("near_n") >= ratio * F.col("n")
    judged = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    jumps = materialise(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = materialise(jumps.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(jumps)
        jumps = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            break
    return judged.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
