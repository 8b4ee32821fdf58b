import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import token_align
from starloom.llm.queries import QUERIES

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["Hello world, don't stop", "", None, " leading", "trailing  ", "two  blanks\n\n newline\t tab ", "naïve 日本語 🙂🙂 x", "a▁b plain", "<|endoftext|> <s> </s> <unk> <0x41>",
         "\u0000 nul", "Ünïcödé nbsp em \x1c\x1dx \x85 y", "word " * 3000, "x" * 4000, "é" * 300 + " " + "ﬁ ½ ² İ", "\r\n \r\n  a", "   ", "1234567890 12 3 4", "ﷺ fine"]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(library, text):
    """Whole-text (id, bytes) lists of both tokenizers."""
    a, b = library
    byte_of = {chr(i): i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [i for i in range(256) if chr(i) not in byte_of]
    byte_of |= {chr(256 + k): i for k, i in enumerate(rest)}
    in_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    in_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        in_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return in_a, in_b


def brute_force(library, rows):
    out, counts = [], Counter()
    for doc, text in rows:
        in_a, in_b = tokens(library, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in in_a) != raw or b"".join(x for _, x in in_b) != raw:
            out.append((doc, 0, 0, [], []))
            continue
        spans = []
        for side in (in_a, in_b):
            at, here = 0, []
            for i, x in side:
                here.append((at, at + len(x), i))
                at += len(x)
            spans.append(here)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        ia = ib = 0
        for end in both:
            ga, gb = [], []
            while ia < len(spans[0]) and spans[0][ia][1] <= end:
                ga.append(str(spans[0][ia][2]))
                ia += 1
            while ib < len(spans[1]) and spans[1][ib][1] <= end:
                gb.append(str(spans[1][ib][2]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        out.append((doc, len(in_a), len(in_b), groups, links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(d, na, nb, len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in out]


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_brute_force(spark, library, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, TEXTS[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    expected = key(brute_force(library, [r[:2] for r in rows]))
    assert key(token_align.align(df, A, B).collect()) == expected
    assert token_align.align(df.limit(0), A, B).count() == 0


def test_registered_query_equals_brute_force(spark, library):
    import pyarrow.parquet as pq
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert key(got) == key(brute_force(library, [(d["doc_id"], d["text"]) for d in docs]))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sZ é\n\t  　\x1c\x85日🙂1.,-_▁<"), max_size=30))
def test_units_join_to_the_whole_text(library, text):
    encoders = token_align._encoders((open(A, encoding="utf-8").read(), open(B, "rb").read()))
    assert encoders.cuts
    if not text:
        return
    parts = encoders.encode(encoders.units(text))
    in_a, in_b = tokens(library, text)
    raw = (" " + text).encode()
    if b"".join(x for _, x in in_a) == raw and b"".join(x for _, x in in_b) == raw:
        assert np.frombuffer(b"".join(p[0] for p in parts), "<u4").tolist() == [i for i, _ in in_a]
        assert np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist() == [i for i, _ in in_b]
    else:
        assert any(not p[0] for p in parts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_pointer_jumping_labels_components(a, b):
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    end = max(a_ends[-1], b_ends[-1])
    a_ends, b_ends = (np.append(x, end) if x[-1] < end else x for x in (a_ends, b_ends))
    in_a, in_b = token_align.group_labels(a_ends, b_ends)
    shared = np.intersect1d(a_ends, b_ends)
    assert in_a.tolist() == np.searchsorted(shared, a_ends, "left").tolist() and in_b.tolist() == np.searchsorted(shared, b_ends, "left").tolist()

