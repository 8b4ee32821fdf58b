"""Language-model scoring by context-tree weighting.

The source is the text's bytes (A-Z lower-cased) and one end byte (0xFF, never
part of UTF-8).  A byte is decomposed into eight binary decisions; each context
(the last d bytes, d = 0 .. depth) keeps Krichevsky-Trofimov estimates of every
decision, and the weighted probability of a context mixes its own estimate with
the product of its children's, half and half, down to the leaves.  Predicting
from the counts of the training texts mixes the estimates of all depths.

Every context seen in a training text is in the tree, however rare, so the
tree grows with the corpus; it is a table, never held in one place.  Each block
keeps its distinct byte (depth+1)-grams with their training counts (0 where only
held-out texts have them).  They are dealt by the ``TOP`` nearest bytes of their
context into buckets; a bucket sums its grams' counts and weights the subtrees
below its contexts, the weights of the contexts of ``TOP`` bytes alone meet in
the driver (at most the byte (TOP+1)-grams of the corpus), and the buckets then
mix downwards and return to every block one value per distinct gram.

The words of the base score go the same way: a block's distinct words are dealt
by a hash, summed in their bucket, and their corpus counts return to the block.

Defined results: null and empty texts hold the end alone; a null id is never
held out; repeated rows count and score each; long texts are scored whole; an
empty table gives an empty result; with no training text every estimate is 1/2;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .arrow_text import blocks, buffers, column, gather_runs, split_words, texts_of
from .storage import materialise

DEPTH = 5
RARITY = 14     # of in-memory trees in tests; score_documents admits every context
TOP = 3
END = 255
BLOCK = 8 << 20
GRAM_BLOCK = 1 << 20
BUCKET = 1 << 20


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, a tenth of the ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def padded(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``depth`` end bytes and before one; the
    first position and the number of positions to score per text."""
    offsets, raw = buffers(texts)
    lengths = np.diff(offsets)
    firsts = offsets[:-1] + np.arange(1, len(lengths) + 1) * depth + np.arange(len(lengths))
    out = np.full(len(raw) + len(lengths) * (depth + 1), END, np.uint8)
    out[gather_runs(firsts, lengths)] = raw
    return out, firsts, lengths + 1


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.add.reduceat(counts[order], starts)


def _position_grams(texts: pa.Array, depth: int):
    """(first row, end row, lengths, gram of every position) of row ranges of
    bounded size; a gram is depth+1 bytes as an integer, context first."""
    offsets, _ = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GRAM_BLOCK, side="right")) - 1)
        data, firsts, lengths = padded(texts_of(texts.slice(start, end - start)), depth)
        at = gather_runs(firsts, lengths)
        grams = np.zeros(len(at), np.int64)
        for d in range(depth, -1, -1):
            grams <<= 8
            grams |= data[at - d]
        yield start, end, lengths, grams
        start = end


def _run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def gram_counts(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (depth+1)-byte grams, context first, as integers, and counts."""
    seen = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for _, _, _, grams in _position_grams(texts, depth):
        grams.sort()
        starts = _run_starts(grams)
        seen.append((grams[starts], np.diff(np.append(starts, len(grams)))))
    grams, counts = (np.concatenate(x) for x in zip(*seen))
    return _summed(grams, counts) if len(grams) else (grams, counts)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after shifting x by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - shift


class ContextTree:
    """Weighted tree over admitted contexts: per leaf, the log10 probability of
    every byte; per node and byte, the child to go to."""

    def __init__(self, counts: list[dict[int, np.ndarray]], depth: int):
        """``counts[d]``: context of d bytes (its oldest byte highest) -> 256
        byte counts; closed under dropping the oldest byte."""
        ids = [{c: i for i, c in enumerate(sorted(level))} for level in counts]
        base = np.cumsum([0, *map(len, counts)])
        total = int(base[-1])
        parent = np.full(total, -1, np.int64)
        table = np.zeros((total, 256))
        level_of = np.zeros(total, np.int64)
        below = np.zeros((total, 256))
        for d, level in enumerate(counts):
            for c, i in ids[d].items():
                node = base[d] + i
                table[node], level_of[node] = level[c], d
                if d:
                    parent[node] = base[d - 1] + ids[d - 1][c & ((1 << 8 * (d - 1)) - 1)]
                    below[parent[node]] += level[c]
        internal = np.unique(parent[parent >= 0])
        # one more leaf below each internal node, for the contexts not admitted
        other = np.full(total, -1, np.int64)
        other[internal] = total + np.arange(len(internal))
        table = np.vstack([table, table[internal] - below[internal]])
        parent = np.concatenate([parent, internal])
        level_of = np.concatenate([level_of, level_of[internal] + 1])
        n = len(table)
        is_leaf = np.ones(n, bool)
        is_leaf[internal] = False

        heap = np.zeros((n, 512))
        heap[:, 256:] = table
        for k in range(255, 0, -1):
            heap[:, k] = heap[:, 2 * k] + heap[:, 2 * k + 1]
        zeros, ones = heap[:, 2:512:2], heap[:, 3:512:2]                 # decisions 1 .. 255
        estimate = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
        p_one = (ones + 0.5) / (zeros + ones + 1)
        del heap, zeros, ones
        weighted, product = estimate.copy(), np.zeros_like(estimate)
        for d in range(depth, -1, -1):                                   # leaves first
            here = np.flatnonzero((level_of == d) & ~is_leaf)
            weighted[here] = np.logaddexp(estimate[here], product[here]) - np.log(2)
            rows = np.flatnonzero(level_of == d)
            rows = rows[parent[rows] >= 0]
            np.add.at(product, parent[rows], weighted[rows])
        own = np.where(is_leaf[:, None], 1.0, np.exp(np.minimum(estimate - weighted - np.log(2), 0)))
        del estimate, weighted, product
        mixed, rest = own * p_one, 1 - own
        for d in range(1, depth + 1):
            rows = np.flatnonzero(level_of == d)
            up = parent[rows]
            mixed[rows] = mixed[up] + rest[up] * own[rows] * p_one[rows]
            rest[rows] = rest[up] * (1 - own[rows])
        mixed = np.clip(mixed, 1e-300, 1 - 1e-16)
        path = np.zeros((n, 512))
        for k in range(1, 256):
            path[:, 2 * k] = path[:, k] + np.log10(1 - mixed[:, k - 1])
            path[:, 2 * k + 1] = path[:, k] + np.log10(mixed[:, k - 1])

        self.depth = depth
        self.log10 = path[:, 256:].astype(np.float32)
        self.child = np.repeat(np.arange(n, dtype=np.int32)[:, None], 256, axis=1)
        self.child[internal] = other[internal][:, None]
        for d in range(1, len(counts)):
            for c, i in ids[d].items():
                node = base[d] + i
                self.child[parent[node], c >> 8 * (d - 1)] = node

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of every text with its end."""
        data, firsts, lengths = padded(texts, self.depth)
        out = np.zeros(len(lengths))
        child, log10 = self.child.reshape(-1), self.log10.reshape(-1)
        step = 1 << 20                          # positions per pass, to bound memory
        ends = firsts + lengths
        row = 0
        while row < len(lengths):
            last = max(row + 1, int(np.searchsorted(ends, firsts[row] + step, side="right")))
            for lo in range(int(firsts[row]), int(ends[last - 1]), step):
                hi = min(lo + step, int(ends[last - 1]))
                node = np.zeros(hi - lo, np.int64)
                for d in range(1, self.depth + 1):
                    node = child[node * 256 + data[lo - d:hi - d]].astype(np.int64)
                value = np.concatenate([[0.0], np.cumsum(log10[node * 256 + data[lo:hi]], dtype=np.float64)])
                a, b = np.clip(firsts[row:last], lo, hi) - lo, np.clip(ends[row:last], lo, hi) - lo
                out[row:last] += value[b] - value[a]
            row = last
        return out


class Subtrees:
    """The parts of the weighted tree between the contexts of ``root`` and of
    ``depth`` bytes over sorted distinct (depth+1)-byte grams and their counts;
    grams of count 0 are those that only scored texts hold.  Only decisions on
    the path of a gram are kept; per level and bit they are in the order of
    (context, decided bits)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, root: int):
        self.depth, self.root, self.grams = depth, root, grams
        self.keys, self.counts, self.up, self.nodes = {}, {}, {}, {}
        for d in range(depth, root - 1, -1):
            self.keys[d], self.counts[d] = grams, counts
            self.nodes[d] = []
            for bit in range(8):
                ids = grams >> (8 - bit)
                starts = _run_starts(ids)
                of = np.zeros(len(ids), np.int32)
                of[starts[1:]] = 1
                ones = np.add.reduceat(counts * (grams >> (7 - bit) & 1), starts).astype(float)
                zeros = np.add.reduceat(counts, starts) - ones
                estimate = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
                self.nodes[d].append((ids[starts], starts, np.cumsum(of, dtype=np.int32), estimate, (ones + 0.5) / (zeros + ones + 1)))
            if d > root:
                grams, self.up[d] = np.unique(grams & ((1 << 8 * d) - 1), return_inverse=True)
                summed = np.zeros(len(grams), np.int64)
                np.add.at(summed, self.up[d], counts)
                counts = summed

    def _above(self, d: int, bit: int) -> np.ndarray:
        """Nodes of level d-1 over the nodes of level d."""
        return self.nodes[d - 1][bit][2][self.up[d][self.nodes[d][bit][1]]]

    def weigh(self, deepest: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Log weights of the root level's nodes per bit, from the leaves'
        estimates or the given weights of the deepest level."""
        self.weights = {self.depth: deepest or [n[3] for n in self.nodes[self.depth]]}
        for d in range(self.depth - 1, self.root - 1, -1):
            self.weights[d] = []
            for bit, (ids, _, _, estimate, _) in enumerate(self.nodes[d]):
                product = np.bincount(self._above(d + 1, bit), self.weights[d + 1][bit], len(ids))
                self.weights[d].append(np.logaddexp(estimate, product) - np.log(2))
        return self.weights[self.root]

    def mix(self, above: list[tuple[np.ndarray, np.ndarray]], last: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(mixed probability of a one, share left to deeper contexts) per bit
        and node of level ``last``, from those above the root level's nodes."""
        for d in range(self.root, last + 1):
            here = []
            for bit, (_, _, _, estimate, p_one) in enumerate(self.nodes[d]):
                mixed, rest = above[bit] if d == self.root else (x[self._above(d, bit)] for x in above[bit])
                own = 1.0 if d == self.depth else np.exp(np.minimum(estimate - self.weights[d][bit] - np.log(2), 0))
                here.append((mixed + rest * own * p_one, rest * (1 - own)))
            above = here
        return above

    def log10(self, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of every gram's last byte after its context."""
        out = np.zeros(len(self.grams))
        for bit, (mixed, _) in enumerate(self.mix(above, self.depth)):
            mixed = np.clip(mixed, 1e-300, 1 - 1e-16)[self.nodes[self.depth][bit][2]]
            out += np.log10(np.where(self.grams >> (7 - bit) & 1, mixed, 1 - mixed))
        return out.astype(np.float32)


def top_states(parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], root: int):
    """Per bit: nodes of the ``root`` level, and the mixed probability and the
    share left above them; from the root level's (grams, counts, weights) of
    disjoint subtrees."""
    grams, counts = _summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
    tree = Subtrees(grams, counts, root, 0)
    given = []
    for bit in range(8):
        ids = np.concatenate([p[0][_run_starts(p[0] >> (8 - bit))] >> (8 - bit) for p in parts])
        given.append(np.concatenate([p[2][bit] for p in parts])[np.argsort(ids)])
    tree.weigh(given)
    first = [(np.zeros(len(n[0])), np.ones(len(n[0]))) for n in tree.nodes[0]]
    if root:
        first = tree.mix(first, root - 1)
        first = [tuple(x[tree._above(root, bit)] for x in first[bit]) for bit in range(8)]
    return [(n[0], *s) for n, s in zip(tree.nodes[root], first)]


def _pack(values: np.ndarray, rising: bool) -> bytes:
    """Integers as compressed byte planes, rising ones by their differences."""
    values = np.diff(values, prepend=0) if rising else values
    return pa.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, rising: bool) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, size).T).view(np.int64).ravel()
    return np.cumsum(values) if rising else values


def _pack_words(words: pa.Array) -> bytes:
    """Size and compressed bytes of blank-free words, each after a line break."""
    text = pc.binary_join_element_wise(words.cast(pa.large_string()), *[pa.scalar(x, pa.large_string()) for x in ("", "\n")])
    raw = buffers(texts_of(text))[1].tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(data: bytes) -> pa.Array:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw))
    return pc.utf8_rtrim(held, "\n")


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of a word, by a polynomial hash of its bytes."""
    offsets, raw = buffers(texts_of(words))
    if not len(words):
        return np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    hashed = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[gather_runs(np.zeros(len(lengths), np.int64), lengths)], offsets[:-1])
    return ((hashed ^ hashed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % buckets


def bucket_of(grams: np.ndarray, root: int, buckets: int) -> np.ndarray:
    """The bucket of a gram, by the ``root`` nearest bytes of its context."""
    context = (grams >> 8 & ((1 << 8 * root) - 1)).astype(np.uint64)
    return (context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


_BLOCKS = ("block long, row long, doc {id}, held_out boolean, text string, "
           "n_words long, train_words long, words binary, word_counts binary, n_grams long, grams binary, gram_counts binary")


def _collect_blocks(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """Stored blocks: their documents' rows, and one row with the block's
    distinct words and byte grams, counted over its training documents."""
    picked = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"),
                         held_out(F.col(id_col)).alias("__held"), F.col(text_col).cast("string").alias("__text"))
    id_type = picked.schema["__id"].dataType.simpleString()
    names = ["block", "row", "doc", "held_out", "text", "n_words", "train_words", "words", "word_counts", "n_grams", "grams", "gram_counts"]

    def gather(batches):
        for part, texts in blocks(batches, "__text", BLOCK):
            size, row, held = part.num_rows, column(part, "__row"), column(part, "__held")
            block = pa.array([row[0].as_py()] * size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block, row, column(part, "__id"), held, texts.cast(pa.string()),
                 *[pa.nulls(size, kind) for kind in (pa.int64(), *(pa.int64(), pa.binary(), pa.binary()) * 2)]], names=names)
            low = pc.ascii_lower(texts)
            offsets, codes, words = split_words(low)
            train = ~held.to_numpy(zero_copy_only=False)
            counts = np.bincount(codes[np.repeat(train, np.diff(offsets))], minlength=len(words))
            grams, gram_n = gram_counts(texts_of(low.filter(pa.array(train))), depth)
            others, _ = gram_counts(texts_of(low.filter(pa.array(~train))), depth)
            grams, gram_n = _summed(np.concatenate([grams, others]), np.concatenate([gram_n, np.zeros(len(others), np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [block[:1], pa.nulls(1, pa.int64()), pa.nulls(1, column(part, "__id").type), pa.nulls(1, pa.bool_()),
                 pa.nulls(1, pa.string()), pa.array([len(words)], pa.int64()), pa.array([counts.sum()], pa.int64()), pa.array([_pack_words(words)], pa.binary()),
                 pa.array([_pack(counts, False)], pa.binary()),
                 pa.array([len(grams)], pa.int64()), pa.array([_pack(grams, True)], pa.binary()),
                 pa.array([_pack(gram_n, False)], pa.binary())], names=names)

    return materialise(picked.mapInArrow(gather, _BLOCKS.format(id=id_type)), "lm-blocks")


def dealt_blocks(stats: DataFrame, depth: int, buckets: int) -> DataFrame:
    """The blocks' grams and words with their training counts by bucket."""
    root = min(TOP, depth)

    def deal(batches):
        def rows(words, block, bucket, items, counts, pack):
            order = np.argsort(bucket, kind="stable")
            bucket, counts = bucket[order], counts[order]
            items = items.take(pa.array(order)) if words else items[order]
            cuts = np.append(_run_starts(bucket), len(bucket))
            spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
            return pa.RecordBatch.from_arrays(
                [pa.array([words] * len(spans), pa.bool_()), pa.array([block] * len(spans), pa.int64()), pa.array(bucket[cuts[:-1]], pa.int64()),
                 pa.array(np.diff(cuts), pa.int64()), pa.array([pack(items[x:y]) for x, y in spans], pa.binary()),
                 pa.array([_pack(counts[x:y], False) for x, y in spans], pa.binary())],
                names=["words", "block", "bucket", "n", "items", "counts"])

        for b in batches:
            for r in b.to_pylist():
                grams, counts = _unpack(r["grams"], r["n_grams"], True), _unpack(r["gram_counts"], r["n_grams"], False)
                yield rows(False, r["block"], bucket_of(grams, root, buckets), grams, counts, lambda x: _pack(x, True))
                if r["n_words"]:
                    words, counts = _unpack_words(r["words"]), _unpack(r["word_counts"], r["n_words"], False)
                    yield rows(True, r["block"], word_buckets(words, buckets), words, counts, _pack_words)

    return (stats.select("block", "n_words", "words", "word_counts", "n_grams", "grams", "gram_counts")
            .mapInArrow(deal, "words boolean, block long, bucket long, n long, items binary, counts binary"))


def bucket_values(stats: DataFrame, depth: int, buckets: int) -> tuple[DataFrame, int]:
    """(words, of_block, bucket, values): of a block's distinct grams of a bucket
    the log10 probabilities, as 4-byte floats in the grams' order, and of its
    words the training counts, as 8-byte integers in the words' order; and the
    number of distinct training words."""
    root = min(TOP, depth)
    dealt = dealt_blocks(stats, depth, buckets)

    def counts_of(t: pa.Table) -> np.ndarray:
        return np.concatenate([_unpack(c.as_py(), n, False) for c, n in zip(t["counts"], t["n"].to_pylist())])

    def tree_of(t: pa.Table) -> Subtrees:
        grams = np.concatenate([_unpack(g.as_py(), n, True) for g, n in zip(t["items"], t["n"].to_pylist())])
        return Subtrees(*_summed(grams, counts_of(t)), depth, root)

    def word_counts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        encoded = pa.concat_arrays([_unpack_words(w.as_py()) for w in t["items"]]).dictionary_encode()
        codes, summed = encoded.indices.to_numpy(), np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(summed, codes, counts_of(t))
        return codes, summed

    def roots(t: pa.Table) -> pa.Table:
        if t["words"][0].as_py():
            grams, counts, weights, distinct = None, None, None, int((word_counts(t)[1] > 0).sum())
        else:
            tree = tree_of(t)
            grams, counts, weights, distinct = tree.keys[root], tree.counts[root], tree.weigh(), 0
        return pa.table({"grams": pa.array([grams], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
                         "weights": pa.array([weights], pa.list_(pa.list_(pa.float64()))), "distinct": pa.array([distinct], pa.int64())})

    # the byte (TOP+1)-grams alone, however many positions hold them
    top = dealt.groupBy("words", "bucket").applyInArrow(
        roots, "grams array<long>, counts array<long>, weights array<array<double>>, distinct long").toArrow()
    parts = [(np.array(g, np.int64), np.array(c, np.int64), [np.array(x) for x in w])
             for g, c, w in zip(*(top[name].to_pylist() for name in ("grams", "counts", "weights"))) if g is not None]
    states = stats.sparkSession.sparkContext.broadcast(top_states(parts, root) if parts else None)

    def values(t: pa.Table) -> pa.Table:
        sizes = t["n"].to_pylist()
        if t["words"][0].as_py():
            codes, summed = word_counts(t)
            out = [x.tobytes() for x in np.split(summed[codes], np.cumsum(sizes)[:-1])]
        else:
            tree = tree_of(t)
            tree.weigh()
            above = []
            for (ids, *state), node in zip(states.value, tree.nodes[root]):
                at = np.searchsorted(ids, node[0])
                above.append(tuple(x[at] for x in state))
            found = tree.log10(above)
            out = [found[np.searchsorted(tree.grams, _unpack(g.as_py(), n, True))].tobytes() for g, n in zip(t["items"], sizes)]
        return pa.table({"words": t["words"], "of_block": t["block"], "bucket": t["bucket"], "values": pa.array(out, pa.binary())})

    found = dealt.groupBy("words", "bucket").applyInArrow(values, "words boolean, of_block long, bucket long, values binary")
    return found, int(pc.sum(top["distinct"]).as_py() or 0)


def block_scores(texts: pa.Array, depth: int, buckets: int, values: dict[int, bytes]) -> np.ndarray:
    """log10 probability of every text with its end, from the values of the
    block's distinct grams by bucket."""
    seen = []
    for start, end, lengths, grams in _position_grams(texts, depth):
        order = np.argsort(grams).astype(np.int32)
        grams = grams[order]
        starts = _run_starts(grams)
        seen.append((start, end, lengths, order, starts, grams[starts]))
    distinct = np.unique(np.concatenate([s[-1] for s in seen]))
    log10 = np.zeros(len(distinct), np.float32)
    order = np.argsort(bucket_of(distinct, min(TOP, depth), buckets), kind="stable")
    log10[order] = np.frombuffer(b"".join(values[b] for b in sorted(values)), np.float32)
    out = np.zeros(len(texts))
    for start, end, lengths, order, starts, grams in seen:
        each = np.zeros(len(order))
        each[order] = np.repeat(log10[np.searchsorted(distinct, grams)], np.diff(np.append(starts, len(order))))
        out[start:end] = np.diff(np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths)])])
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability under the tree), n_bytes (with the end) and
    bits_per_byte."""
    spark = docs.sparkSession
    stored = _collect_blocks(docs, id_col, text_col, depth)
    documents = stored.where("row is not null").select("block", "row", "doc", "held_out", "text")
    stats = stored.where("row is null")

    entries = stats.agg(F.sum(F.col("n_grams") + F.col("n_words")), F.sum("train_words")).first()
    buckets = max(-(-(entries[0] or 0) // BUCKET), 4 * shuffle_partitions(spark))
    found, distinct = bucket_values(stats, depth, buckets)
    train_docs = documents.where("not held_out").count()
    train_tokens, distinct = (entries[1] or 0) + train_docs, distinct + (1 if train_docs else 0)
    scale = float(np.log10(train_tokens + 0.1 * (distinct + 1)))

    id_type = stored.schema["doc"].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    schema = (f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, n_bytes long, bits_per_byte double")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("row")
        texts = texts_of(pc.ascii_lower(left["text"].combine_chunks()))
        offsets, codes, words_here = split_words(texts)

        def of(words):
            part = right.filter(pc.equal(right["words"], words))
            return dict(zip(part["bucket"].to_pylist(), part["values"].to_pylist()))
        count = np.zeros(len(words_here) + 1)
        back = of(True)
        count[np.argsort(word_buckets(words_here, buckets), kind="stable")] = np.frombuffer(b"".join(back[b] for b in sorted(back)), np.int64)
        per_word = np.log10(count[:-1] + 0.1)

        def sums(values):
            return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])
        n_tokens = np.diff(offsets) + 1
        base = sums(per_word[codes]) + np.log10(train_docs + 0.1) - n_tokens * scale
        total, size = block_scores(texts, depth, buckets, of(False)), np.diff(buffers(texts)[0]) + 1
        return pa.Table.from_arrays(
            [left["doc"], left["held_out"], pa.array(n_tokens, pa.int64()),
             pa.array(sums((count[:-1] > 0)[codes].astype(np.int64)) + (1 if train_docs else 0), pa.int64()),
             pa.array(np.full(len(n_tokens), train_tokens), pa.int64()), pa.array(base), pa.array(total),
             pa.array(size, pa.int64()), pa.array(-total / np.log10(2) / size)], names=names)

    return documents.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(score, schema)
