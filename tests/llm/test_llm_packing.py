import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import packing
from starloom.llm.arrow_text import texts_of

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [None, "", "don't it's THEY'RE", "a<|endoftext|>b <|endoftext|>", "İstanbul ΣΑΣ ét", "x y\x1cq", "... !!! '' \"'s", "naïve—dash 日本語 🙂🙂",
         "1234 a1b2 ½ ª º", "ÀÉ.| a|b |", "_x_ foo_bar", "\u0000a", "word " * 9000, "Ünïcödé " * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    tokenizer = packing.tokenizer_for(open(PATH, encoding="utf-8").read())
    texts = [t or "" for t in TEXTS]
    import pyarrow as pa
    offsets, ids = tokenizer.encode(texts_of(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_placement_is_gapless_and_tight(lengths):
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, offset = packing.place(lengths, 64)
    for s in set(sequence.tolist()):
        mine = sorted(zip(offset[sequence == s], lengths[sequence == s]))
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(n for _, n in mine) <= 64
    if len(lengths):  # no more than first-fit-decreasing's bound
        assert sequence.max() + 1 <= 11 / 9 * -(-lengths.sum() // 64) + 4


def test_pieces_and_sequences(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(df, PATH).collect()
    expected = []
    for doc, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(doc, p, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(r[:5] for r in out) == sorted(expected)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) <= 4096 for v in by.values())
    assert len(by) == -(-sum(r.length for r in out) // 4096)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_placement_takes_the_smallest_sum_of_squares(lengths):
    """Every step against all open sequences, one by one."""
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, offset = packing.place(lengths, 20)
    gaps = {}
    for size, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def after(chosen):
            new = {**gaps, chosen: gaps[chosen] - size}
            counts = np.bincount(list(new.values()), minlength=21)[1:]
            return int((counts ** 2).sum())
        fits = [c for c, g in gaps.items() if g >= size]
        if not fits:
            assert s not in gaps
            gaps[s] = 20
        else:
            best = min(after(c) for c in fits)
            assert after(s) == best and gaps[s] == min(gaps[c] for c in fits if after(c) == best)
        assert at == 20 - gaps[s]
        gaps[s] -= size


def test_shards_grow_with_pieces_and_split_repeated_rows(spark):
    """Books make many pieces of few documents; repeated rows spread over all shards."""
    rows = [(1, 0, 0, 7, 9)] * 4000 + [(2, p, p * 64, 64, 1) for p in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(table, capacity=64, shard_pieces=500).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.sequence_id % 12, []).append(r)
    assert len(out) == 6000 and len(shards) == 12 and max(map(len, shards.values())) < 700
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) <= 2000 + -(-4000 // 9) + 12 and all(sum(n for _, n in v) <= 64 for v in by.values())
