import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import spelling
from starloom.llm.queries import QUERIES


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def grouped(words):
    """Near words by deleting every place (a wildcard for a replacement)."""
    masks = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "*" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_registered_query_equals_brute_force(spark):
    import pyarrow.parquet as pq
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = grouped(words_of((d["doc_id"], d["text"]) for d in docs))
    got = sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()))
    assert got == expected and any(r[1] for r in got)


def test_cells_and_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(6, 9))) for _ in range(400)]
    words = {w: int(rng.integers(5, 200)) for w in base}
    words |= {w[:3] + "x" + w[3:]: 5 for w in base[:100]} | {w[:2] + "q" + w[3:]: 7 for w in base[100:200]}
    words |= {"abcdef": 10_000, "abcdeg": 2000, "abcdegg": 400, "abcdeggg": 80, "abcdegggg": 16}
    # anagrams share one vector: no tree can part them
    words |= {"".join(rng.permutation(list("aabbccdd"))): 9 for _ in range(300)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = grouped(words)
    for cell, block in ((40, 25), (2048, 8192)):
        got = spelling.variant_groups(table, cell=cell, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got)) == expected
    assert [r[2] for r in expected if r[0] == "abcdegggg"] == ["abcdef"]


def test_counting_rules(spark):
    texts = ["Straße STRASSE straßE ÉTÉÉTÉ étéété x÷y×zzz aaa", None, "", "été" * 400_000, "word_break break'word ABCDEFĀghijkl"] * 6
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[0], "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == words_of((r[0], r[1]) for r in rows) and len(got) >= 5
    assert spelling.variant_groups(spelling.word_counts(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=4, max_size=4), min_size=1, max_size=30, unique=True), st.lists(st.text("abé", min_size=4, max_size=5), min_size=1, max_size=30, unique=True))
def test_near_pairs(queries, words):
    for length in (4, 5):
        held = [w for w in words if len(w) == length]
        if not held:
            continue
        got = sorted((queries[a], held[b]) for q, w in spelling.near_pairs(queries, held) for a, b in zip(q, w))
        if length == 4:
            want = [(a, b) for a in queries for b in held if a < b and sum(x != y for x, y in zip(a, b)) == 1]
        else:
            want = [(a, b) for a in queries for b in held if any(b[:i] + b[i + 1:] == a for i in range(5))]
        assert got == sorted(want)
