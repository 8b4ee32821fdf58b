import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from starloom.llm import context_tree as ct
from starloom.llm.arrow_text import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def array(texts):
    return texts_of(pa.array(texts, pa.string()))


def tree_of(texts, depth, rarity):
    grams, counts = ct.gram_counts(array(texts), depth)
    levels = []
    for d in range(depth + 1):
        level = {}
        for g, n in zip((grams & ((1 << 8 * (d + 1)) - 1)).tolist(), counts.tolist()):
            level.setdefault(g >> 8, np.zeros(256))[g & 255] += n
        levels.append({c: t for c, t in level.items() if t.sum() * (1 << rarity) >= counts.sum() or d == 0})
    return ct.ContextTree([lv for lv in levels if lv], depth)


def kt(zeros, ones):
    return math.exp(math.lgamma(zeros + .5) + math.lgamma(ones + .5) - math.lgamma(zeros + ones + 1)) / math.pi


def brute_probability(train, text, depth):
    """Sequential definition with every seen context admitted: ratio of the
    weighted probabilities of a tree after and before a bit, by recursion."""
    def weighted(counts, node, d):
        here = counts.get((d, node), [0, 0])
        own = kt(*here)
        children = [c for (e, c) in counts if e == d + 1 and (c[0][-d:] if d else b"") == node[0] and c[1] == node[1]]
        if d == depth or not any(e == d + 1 and (c[0][-d:] if d else b"") == node[0] for (e, c) in counts):
            return own
        product = 1.0
        for c in children:
            product *= weighted(counts, c, d + 1)
        return (own + product) / 2

    counts = {}
    for t in train:
        data = b"\xff" * depth + t.encode() + b"\xff"
        for i in range(depth, len(data)):
            for bit in range(8):
                prefix = (1 << bit) | (data[i] >> (8 - bit))
                for d in range(depth + 1):
                    counts.setdefault((d, (data[i - d:i], prefix)), [0, 0])[data[i] >> (7 - bit) & 1] += 1
    total = 0.0
    data = b"\xff" * depth + text.encode() + b"\xff"
    for i in range(depth, len(data)):
        for bit in range(8):
            prefix, value = (1 << bit) | (data[i] >> (8 - bit)), data[i] >> (7 - bit) & 1
            before = weighted(counts, (b"", prefix), 0)
            after = {k: list(v) for k, v in counts.items()}
            for d in range(depth + 1):
                after.setdefault((d, (data[i - d:i], prefix)), [0, 0])[value] += 1
            total += math.log10(weighted(after, (b"", prefix), 0) / before)
    return total


def test_score_equals_the_definition():
    train = ["abab", "abba a", "ba"]
    tree = tree_of(train, 1, 30)
    for text in train + ["ab", ""]:                  # contexts that the tree holds
        assert math.isclose(tree.score(array([text]))[0], brute_probability(train, text, 1), rel_tol=1e-5), text


def test_probabilities_sum_to_one_and_blocks_agree(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd é\n"), size=int(rng.integers(0, 200)))) for _ in range(60)]
    tree = tree_of(texts, 3, 8)
    reachable = np.unique(tree.child)
    assert np.allclose((10.0 ** tree.log10[reachable].astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    one = [tree.score(array([t]))[0] for t in texts]
    assert np.allclose(tree.score(array(texts)), one)
    assert np.allclose(tree.score(array(["".join(texts) * 300]))[0], tree.score(array(["".join(texts) * 300]))[0])


def test_contexts_help_on_held_out_text():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), size=4)) for _ in range(30)]
    texts = [" ".join(rng.choice(words, size=40)) for _ in range(80)]
    bits = [-tree_of(texts[:60], d, 12).score(array(texts[60:])).sum() / math.log10(2) / sum(len(t) + 1 for t in texts[60:]) for d in (0, 1, 3)]
    assert bits[0] > bits[1] > bits[2]


def test_gram_counts_in_blocks(monkeypatch):
    texts = ["abc", "", "abcabc", "x" * 50]
    whole = ct.gram_counts(array(texts), 2)
    monkeypatch.setattr(ct, "GRAM_BLOCK", 4)
    assert all((a == b).all() for a, b in zip(whole, ct.gram_counts(array(texts), 2)))
    assert whole[1].sum() == sum(len(t) + 1 for t in texts)


def test_table_against_brute_force(spark):
    texts = [None, "", "The the THE end", "a b a b \n c", "é é É", "z" * 3000] + [f"doc {i} of the words w{i % 7}" for i in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = ct.score_documents(df).collect()
    assert len(got) == len(rows)
    words = [(i, WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None], t) for i, t, _ in rows]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, ws, _ in words if not out_of(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = {(i, len(ws)): (out_of(i), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + .1) / (total + .1 * (distinct + 1))) for w in ws))
                for i, ws, _ in words}
    for r in got:
        held, known, base = expected[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.bits_per_byte, -r.score / math.log10(2) / r.n_bytes)
    low = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), i) for i, t, _ in rows]
    tree = tree_of([t for t, i in low if not out_of(i)], ct.DEPTH, ct.RARITY)
    scores = {r.doc_id: r.score for r in got}
    for t, i in low:
        assert math.isclose(scores[i], tree.score(array([t]))[0], rel_tol=1e-6)
    assert ct.score_documents(df.limit(0)).count() == 0


def test_rare_contexts_stay_in_a_large_corpus(spark):
    # two texts of six bytes among 2 ** 18 others: contexts of a share under 2 ** -14
    rows = [(i, "ab" * 4096 if i else "xyzzyq") for i in range(40) if i == 0 or zlib.crc32(str(i).encode()) % 10]
    rows += [(10_000, "xyzzyq")]
    assert zlib.crc32(b"0") % 10 and zlib.crc32(b"10000") % 10
    got = {r.doc_id: r.score for r in ct.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    low = array([t for _, t in rows])
    whole, cut = tree_of(low.to_pylist(), ct.DEPTH, 62), tree_of(low.to_pylist(), ct.DEPTH, 14)
    assert whole.score(low)[0] > cut.score(low)[0] + 1
    for (i, _), score in zip(rows, whole.score(low)):
        assert math.isclose(got[i], score, rel_tol=1e-5)
