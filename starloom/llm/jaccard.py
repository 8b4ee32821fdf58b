"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word n-grams (64-bit hashes).  Documents
with equal sets form a class; classes are joined, and documents get the
smallest doc_id they can reach.

Candidates.  Tokens (n-grams) are ordered rare first, then by hash.  A set of n
tokens that shares t*n tokens with another must share one within the first
p = n - ceil(t*n) + 1 of each.  Frequent tokens, dealt to ``SUBCLASSES``
subclasses by hash, are indexed as pairs of one subclass instead: the prefix is
extended until p tokens remain after one token of every subclass in it is
taken off.  Two similar sets then share a rare token or, by the pigeonhole
principle, two frequent tokens of one subclass (both within the extended
prefixes).  Sets too small to extend index single tokens; sets near that size
index both ways.  Any choice of frequent tokens gives the same result; it only
sets the length of the posting lists.

Posting lists.  No list is turned into all its pairs.  Lists are cut into size
bands, and members without a partner of a fitting size leave.  Every member is
first verified against its band's smallest member (leader); links give labels
(connected components).  Only lists that still hold several labels are looked
at again, in rounds with many times as many leaders each: the round's leaders
meet the members of other labels (that the sizes and the triangle inequality of
the Jaccard distance through a first leader leave possible), links join labels, and lists
with one label leave.  In the last round all members lead, so no pair of different
labels is missed.  Similar sets share many lists; a list leaves a pair to the others if
both members have a smaller signature among their lowest ones in common, so that the
list of the smallest common signature always meets it.
Exact upper bounds of the overlap (bucket counts of the two sets, coarse ones in
the second look's join, finer sketches after) prune the candidates; the rest are
verified on the full sets, recomputed from the texts of the candidates alone.

Defined results: null and empty texts have no n-grams and are linked with
nothing; fewer words than n give one n-gram, the whole sequence; doc_id is
expected to be unique, equal repeated rows fall into one class; long texts are
shingled whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import blocks, column, split_words, word_list
from .components import components
from .storage import checkpointed, discard, materialise, settle

SUBCLASSES = 16
REPORT_TOKENS = 2_000_000   # tokens after which a task reports repeated ones
FREQUENT = 8                # reported documents from which a token counts as frequent
MAX_FREQUENT = 1 << 20      # the most frequent tokens kept (8 MB); the rest count as rare
BUCKETS = 64
FILTER_BITS = 1 << 26       # 8 MB
ROUND_GROWTH = 64           # leaders of a list, from round to round
LIST_SLOT = 4096            # members of a list that meet its leaders in one group
LOWEST = 16                 # signatures of a member that tell whether a pair is met in another list
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes (int64) of every text."""
    offsets, codes, words = split_words(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in word_list(words)), np.uint64, len(words))[codes]
    grams = np.zeros(0, np.int64)
    if len(hashes) >= n:
        size = len(hashes) - n + 1
        acc = _mix(hashes[:size])
        for k in range(1, n):
            acc = _mix(acc + hashes[k:k + size])
        grams = acc.view(np.int64)
    out = []
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for h in hashes[a:b]:
                one = _mix(one + np.array([h], np.uint64))[0]
            out.append(np.array([one], np.uint64).view(np.int64))
        else:
            out.append(grams[:0])
    return out


class Scheme:
    """Sizes of prefixes for similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # largest set that may be too small for an extension by every subclass
        self.small = max(n for n in range(1, 8 * SUBCLASSES * den // num) if self.need(n) <= SUBCLASSES)

    def need(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def signatures(self, tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Signatures of a sorted token set; ``frequent`` is sorted."""
        n = len(tokens)
        if not n:
            return tokens
        common = np.zeros(n, bool)
        if len(frequent):
            common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        prefix = n - self.need(n) + 1
        out = []
        ordered = np.concatenate([tokens[~common], tokens[common]]).view(np.uint64)
        rare = n - int(common.sum())
        if n * self.num <= self.small * self.den:
            out.append(_mix(ordered[:prefix] ^ np.uint64(1)))
        if n > self.small:
            group = (_mix(ordered[rare:]) >> np.uint64(32)) % np.uint64(SUBCLASSES)
            counts = np.ones(n, np.int64)
            counts[rare + np.unique(group, return_index=True)[1]] = 0
            length = int(np.searchsorted(np.cumsum(counts), prefix)) + 1
            out.append(_mix(ordered[:min(rare, length)] ^ np.uint64(2)))
            for g in range(SUBCLASSES if length > rare else 0):
                members = ordered[rare:length][group[:length - rare] == g]
                if len(members) > 1:
                    i, j = np.triu_indices(len(members), 1)
                    out.append(_mix(_mix(members[i]) + members[j]))
        return np.unique(np.concatenate(out)).view(np.int64)


def _histogram(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((_mix(tokens.view(np.uint64)) >> np.uint64(58)).astype(np.int64), minlength=BUCKETS)


def _sketch(tokens: np.ndarray) -> bytes:
    """Counts of a power of two of buckets, about three tokens to a bucket, so
    that unrelated sets differ visibly at any size; one byte each."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(tokens)) / 4))))
    counts = np.bincount((_mix(tokens.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _most_shared(x: bytes, y: bytes, n_x: int, n_y: int) -> int:
    """Upper bound of the overlap of two sets of n_x and n_y tokens from their
    sketches; the finer one is folded.  What a full byte lost is added back."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    lost = min(n_x - int(a.sum()), n_y - int(b.sum()))
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = (v.reshape(size, -1).sum(axis=1) for v in (a, b))
    return int(np.minimum(a, b).sum()) + lost


def frequent_tokens(texts: DataFrame, n: int) -> np.ndarray:
    """Sorted n-grams found in many documents: every task counts the n-grams of
    its documents, reports those it saw more than once, and reports are added
    up.  Bounded by ``MAX_FREQUENT``, most frequent first."""
    def report(batches):
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(counts[often].astype(np.int64))],
                                              names=["token", "documents"])

        for _, block in blocks(batches, "__text"):
            sets = shingle_sets(block, n)
            held += sets
            size += sum(map(len, sets))
            if size >= REPORT_TOKENS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    counted = materialise(texts.select("__text").mapInArrow(report, "token long, documents long")
                          .groupBy("token").agg(F.sum("documents").alias("documents"))
                          .where(F.col("documents") >= FREQUENT)
                          .withColumn("level", F.floor(8 * F.log2("documents")).cast("int")), "frequent-tokens")
    left, lowest = MAX_FREQUENT, None
    for level, size in sorted(counted.groupBy("level").count().collect(), reverse=True):  # some hundred levels at most
        if size > left:
            break
        left, lowest = left - size, level
    if lowest is None:
        return np.zeros(0, np.int64)
    return np.sort(counted.where(F.col("level") >= lowest).select("token").toArrow()["token"].to_numpy())


def _signed(texts: DataFrame, n: int, scheme: Scheme, frequent) -> DataFrame:
    """Per document: size and 128-bit digest of its set, bucket counts,
    signatures."""
    def sign(batches):
        common = frequent.value
        for part, block in blocks(batches, "__text"):
            sets = shingle_sets(block, n)
            sigs = [scheme.signatures(s, common) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [column(part, "__id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BUCKETS,
                                          np.concatenate([_histogram(s) for s in sets]).astype(np.int32)),
                 pa.array([_sketch(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(np.cumsum([0, *map(len, sigs)]).astype(np.int32),
                                          np.concatenate(sigs) if sigs else np.zeros(0, np.int64))],
                names=["doc", "n", "digest", "buckets", "sketch", "signatures"])

    id_type = texts.schema["__id"].dataType.simpleString()
    return texts.select("__id", "__text").mapInArrow(
        sign, f"doc {id_type}, n long, digest binary, buckets array<int>, sketch binary, signatures array<long>")


def _bit_filter(slots: DataFrame):
    """Broadcast bit array of the ``slot`` numbers below ``FILTER_BITS``:
    bounded, and only a filter (what passes by chance goes in a later join)."""
    rows = (slots.groupBy(F.expr("slot div 32768").alias("part"))
            .agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return slots.sparkSession.sparkContext.broadcast(bits)


def _passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _shared_only(signed: DataFrame) -> DataFrame:
    """``signed`` with the signatures that several documents hold (and a few
    more, by chance): most are held by one document and need no shuffle of
    whole postings."""
    several = (signed.select(F.explode("signatures").alias("signature")).groupBy("signature").count()
               .where("count > 1").select(F.col("signature").bitwiseAND(FILTER_BITS - 1).alias("slot")))
    shared = _bit_filter(several)

    def thin(batches):
        have = shared.value
        for b in batches:
            at = b.schema.get_field_index("signatures")
            lists = b.column(at)
            values = lists.flatten().to_numpy()
            keep = _passes(have, values & (FILTER_BITS - 1))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            offsets = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
            yield b.set_column(at, "signatures", pa.ListArray.from_arrays(offsets, values[keep]))

    return signed.mapInArrow(thin, signed.schema)


def _sets_of(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the wanted nodes (documents), by a second pass over
    the texts that shingles only rows in a bounded bit filter of the nodes."""
    wanted = _bit_filter(nodes.select(F.pmod(F.xxhash64(F.col("node")), F.lit(FILTER_BITS)).alias("slot")))

    def shingle(batches):
        have = wanted.value
        def chosen():
            for b in batches:
                yield b.filter(pa.array(_passes(have, column(b, "__slot").to_numpy())))
        for part, block in blocks(chosen(), "__text"):
            sets = shingle_sets(block, n)
            yield pa.RecordBatch.from_arrays(
                [column(part, "__id"), pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets))],
                names=["node", "tokens"])

    id_type = texts.schema["__id"].dataType.simpleString()
    found = (texts.select("__id", "__text", F.pmod(F.xxhash64("__id"), F.lit(FILTER_BITS)).alias("__slot"))
             .mapInArrow(shingle, f"node {id_type}, tokens array<long>"))
    return found.join(nodes, "node", "left_semi")


def _prune(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """Drop pairs whose sketches rule the similarity out."""
    sides = [classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def possible(batches):
        for batch in batches:
            n_a, n_b, s_a, s_b = (column(batch, c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))
            most = [_most_shared(*v) for v in zip(s_a, s_b, n_a, n_b)]
            keep = [scheme.den * m >= scheme.num * (x + y - m) for m, x, y in zip(most, n_a, n_b)]
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(possible, f"a {kind}, b {kind}")


def _verify(texts: DataFrame, pairs: DataFrame, n: int, scheme: Scheme) -> DataFrame:
    """(a, b, similarity, linked) of distinct pairs, from their full sets."""
    left = checkpointed(pairs)
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    sets = materialise(_sets_of(texts, nodes, n), "candidate-sets")
    both = (left.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    counted = both.select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb")).alias("sizes"))
    union = F.col("sizes") - F.col("shared")
    judged = checkpointed(counted.select("a", "b", (F.col("shared") / union).alias("similarity"),
                                         (scheme.den * F.col("shared") >= scheme.num * union).alias("linked")))
    discard(sets)
    return judged


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(signature, size) of the lists that hold several labels."""
    return checkpointed(
        _labelled(members, labels).groupBy("signature")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        .where("low < high").select("signature", "size"))


def _due_pairs(rest: DataFrame, mixed: DataFrame, labels: DataFrame, now: int, scheme: Scheme) -> DataFrame:
    """Pairs (a, b), seldom repeated, of different labels, one of which leads from this round
    on and the other does not lead yet, that sizes, the triangle inequality of the
    Jaccard distance through a first leader, and bucket counts leave possible, and that
    no list of a smaller signature among the ``lower`` ones of both meets.  Long lists are dealt to slots, each met by all of the round's leaders."""
    open_lists = _labelled(rest.where(F.col("turn") >= now).join(mixed.select("signature"), "signature", "left_semi"), labels)
    slots = F.ceil(F.col("size") / LIST_SLOT).cast("int")
    held = open_lists.withColumn("slot", F.pmod(F.xxhash64("node"), slots).cast("int"))
    leads = open_lists.where(F.col("turn") == now).withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    leads = leads.select(*[F.col(c).alias(f"{c}_x") for c in ("signature", "slot", "node", "n", "label", "leader", "similarity", "buckets", "lower")])
    n, n_x = F.col("n"), F.col("n_x")
    close = scheme.den * F.least(n, n_x) >= scheme.num * F.greatest(n, n_x)
    apart = (F.col("leader") == F.col("leader_x")) & F.coalesce(
        F.abs(F.col("similarity") - F.col("similarity_x")) > (1 - scheme.num / scheme.den) + 1e-9, F.lit(False))
    met = (F.col("node") == F.col("leader_x")) | (F.col("node_x") == F.col("leader"))       # verified in the first look
    once = (F.col("turn") > now) | (F.col("node_x") < F.col("node"))
    bound = F.aggregate(F.zip_with("buckets", "buckets_x", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return (held.join(leads, (F.col("signature") == F.col("signature_x")) & (F.col("slot") == F.col("slot_x")) & (F.col("label") != F.col("label_x"))
                      & close & ~apart & ~met & once & ~F.arrays_overlap("lower", "lower_x")
                      & (scheme.den * bound >= scheme.num * (n + n_x - bound)))
            .select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
                    num: int = 90, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: documents link when
    ``den * intersection >= num * union`` of their n-gram sets.  ``docs`` is
    read three or four times and should be a stored table."""
    spark, scheme = docs.sparkSession, Scheme(num, den)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, n))
    signed = materialise(_signed(texts, n, scheme, frequent), "signatures")
    classes = materialise(
        _shared_only(signed.where("n > 0 and doc is not null")).groupBy("digest")
        .agg(F.min(F.struct("doc", "n", "buckets", "sketch", "signatures")).alias("c"))
        .select("digest", F.col("c.doc").alias("node"), "c.n", "c.buckets", "c.sketch", "c.signatures"), "classes")

    def close(x: Column, y: Column) -> Column:
        return scheme.den * F.least(x, y) >= scheme.num * F.greatest(x, y)

    # Lists: postings of one signature, cut by size into bands a factor den/num
    # wide, so that similar sets lie in one band or in two adjacent ones.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) * (1 + 1e-9))).cast("int")
    postings = classes.select("node", "n", F.explode("signatures").alias("signature"))
    shared = (postings.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .where("low < high").select("signature"))
    members = materialise(postings.join(shared, "signature").withColumn("band", band), "postings")
    cells = members.groupBy("signature", "band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("first"))
    around = (cells.select("signature", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), "size")
              .groupBy("signature", "band").agg(F.sum("size").alias("around")).where("around > 1").select("signature", "band"))
    cells = cells.join(around, ["signature", "band"]).select(
        "signature", "band", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"))
    postings_of = members
    members = materialise(members.join(cells, ["signature", "band"]), "banded-postings")
    discard(postings_of)
    settle(spark)

    led = (members.where((F.col("node") != F.col("leader")) & close(F.col("n"), F.col("leader_n")))
           .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    first = _verify(texts, _prune(led, classes, scheme), n, scheme)
    labels = components(first.where("linked").select("a", "b"))
    settle(spark)

    # Lists that hold several labels, in rounds.  A member is a leader from the round on
    # that a hash gives it: one or a few of a list, then ``ROUND_GROWTH`` times as many, in the
    # last round all.  A pair is due when the first of its two becomes a leader, and only
    # if no links found so far have joined their labels.
    near = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), "similarity")
    mixed = _mixed(members, labels)
    share = F.pmod(F.xxhash64("node", "signature"), F.lit(1 << 40)) / float(1 << 40)
    turn = F.greatest(F.lit(0), F.ceil(F.log(float(ROUND_GROWTH), share * F.col("size")))).cast("int")
    # counted over the lists mixed now, whatever lists leave later: a list that has left
    # holds one label, and so do its pairs
    lowest = (members.join(mixed.select("signature"), "signature", "left_semi").groupBy("node")
              .agg(F.slice(F.sort_array(F.collect_list("signature")), 1, LOWEST).alias("lowest")))
    rest = materialise(
        members.join(mixed, "signature").select("signature", "node", "n", "leader", "size", F.when(share > 0, turn).otherwise(0).alias("turn"))
        .join(near, ["leader", "node"], "left").join(classes.select("node", "buckets").join(lowest, "node"), "node")
        .withColumn("lower", F.filter("lowest", lambda x: x < F.col("signature"))).drop("lowest"), "mixed-postings")
    discard(members)
    settle(spark)
    turns = rest.agg(F.max("turn")).first()[0]
    for now in range(0 if turns is None else turns + 1):
        if mixed.isEmpty():
            break
        second = _verify(texts, _prune(_due_pairs(rest, mixed, labels, now, scheme).distinct(), classes, scheme), n, scheme)
        more = second.where("linked").select("a", "b")
        if not more.isEmpty():
            labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
        mixed = _mixed(rest, labels)
        settle(spark)
    discard(rest)

    named = classes.select("digest", "node").join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return (signed.select("doc", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
            .join(named, "digest", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc").alias("component_id")))
