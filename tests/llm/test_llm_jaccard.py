import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import jaccard
from starloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, num, den):
    sets = {d: grams(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for a in sets:
        for b, shared in Counter(b for g in sets[a] for b in holders[g] if b < a).items():
            if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, docs=160, vocabulary=400):
    """Chains and stars of near copies, exact copies, a passage that most
    documents share, and texts at the edges of the size rules."""
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(25)]
    texts = []
    for _ in range(docs // 8):
        base = [rng.choice(words) for _ in range(rng.choice((3, 9, 17, 18, 19, 20, 21, 22, 23, 30, 60, 200)))]
        if rng.random() < 0.6:
            base = passage + base if rng.random() < 0.5 else passage[:18] + base[:2]
        for _ in range(8):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice((0, 1, 1, max(1, len(base) // 40)))):
                base[rng.randrange(len(base))] = rng.choice(words)
    return list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE\ttwo"), (9004, "one"), (9005, " \n ")]


@pytest.mark.parametrize("n, num, seed", [(3, 90, 1), (5, 80, 2)])
@pytest.mark.parametrize("frequent", [2, 10 ** 9])
def test_against_brute_force(spark, monkeypatch, n, num, seed, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n=n, num=num, den=100).collect()}
    assert got == brute(rows, n, num, 100)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            words[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 90, 100).items()}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 80), st.integers(0, 2 ** 32), st.sampled_from([(90, 100), (80, 100), (1, 2)]), st.floats(0, 1))
def test_similar_sets_share_a_signature(size, seed, similarity, share):
    rng = np.random.default_rng(seed)
    scheme = jaccard.Scheme(*similarity)
    x = np.unique(rng.integers(-2 ** 62, 2 ** 62, size))
    room = int((1 - similarity[0] / similarity[1]) * len(x) / 2)
    keep = len(x) - int(rng.integers(0, room + 1))
    y = np.unique(np.concatenate([rng.permutation(x)[:keep], rng.integers(-2 ** 62, 2 ** 62, int(rng.integers(0, room + 1)))]))
    shared = len(np.intersect1d(x, y))
    if similarity[1] * shared >= similarity[0] * (len(x) + len(y) - shared):
        frequent = np.sort(rng.permutation(np.union1d(x, y))[:int(share * len(x))])
        assert len(np.intersect1d(scheme.signatures(x, frequent), scheme.signatures(y, frequent)))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q r s t")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 2), ("None", 2, 1)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 3000), st.floats(0, 1), st.integers(0, 2 ** 32))
def test_sketches_never_underestimate(size_x, size_y, share, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(-2 ** 62, 2 ** 62, size_x))
    y = np.unique(np.concatenate([rng.permutation(x)[:int(share * len(x))], rng.integers(-2 ** 62, 2 ** 62, size_y)]))
    shared = len(np.intersect1d(x, y))
    assert shared <= jaccard._most_shared(jaccard._sketch(x), jaccard._sketch(y), len(x), len(y)) <= min(len(x), len(y))


def test_full_sketch_bytes_are_added_back():
    full = np.full(16, 255, np.uint8).tobytes()
    assert jaccard._most_shared(full, full, 10_000, 9_000) == 16 * 255 + 9_000 - 16 * 255


def test_many_rounds_find_the_same(spark, monkeypatch):
    """Leaders doubled from round to round, short slots: nothing between two labels is missed."""
    monkeypatch.setattr(jaccard, "ROUND_GROWTH", 2)
    monkeypatch.setattr(jaccard, "LIST_SLOT", 5)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rows = corpus(3, docs=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_lists_leave_a_pair_to_one_of_them(spark):
    """Sets that share many lists are met once, in the list of their smallest common signature."""
    held = {1: [0, 1, 2, 3], 2: [0, 1, 2, 3, 4], 3: [0, 1, 3, 4, 5], 4: [0, 1, 2, 3, 4, 5]}
    rows = [(s, node, 10, 0, 4, int(node > 1), 0.5 if node else None, [10], [x for x in held if x < s and node in held[x]])
            for s, members in held.items() for node in members]
    rest = spark.createDataFrame(rows, "signature long, node long, n long, leader long, size long, turn int, similarity double, "
                                       "buckets array<int>, lower array<long>").coalesce(1).cache()
    labels = spark.createDataFrame([], "node long, component long")
    scheme = jaccard.Scheme(90, 100)

    def met(signatures, now):
        mixed = spark.createDataFrame([(s,) for s in signatures], "signature long")
        return sorted((r["a"], r["b"]) for r in jaccard._due_pairs(rest, mixed, labels, now, scheme).collect())

    # first looks met all pairs with 0, the leader
    assert met(held, 0) == [(1, x) for x in (2, 3, 4, 5)]
    assert met(held, 1) == [(x, y) for x in (2, 3, 4, 5) for y in (2, 3, 4, 5) if x < y]
    # a list that has left held one label
    assert met([4], 1) == [(2, 5)]
