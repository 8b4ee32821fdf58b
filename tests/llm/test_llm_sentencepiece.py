import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from starloom.llm import sentencepiece_trie as sp

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", "  a  b   ", "\n\n x\ty\r\n", "▁▁ mark ▁", "日本語 テキスト 🙂🙂", "don't  stop!!", "a" * 50 + " " * 40 + "b", "\u0000q", "é é ﬁ",
         "    indented\n        code()\n\treturn 1", "<s> </s> <unk> <0x0A>", "ééé—“quotes”…", " ", "\n", "the the  the   the", "word " * 5000]


def serialised(unigram):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    if unigram:  # the same pieces read as a unigram model, with scores of its kind
        proto.trainer_spec.model_type = 1
        rng = np.random.default_rng(0)
        for p in proto.pieces:
            if p.type == 1:
                p.score = -4 - float(rng.integers(1, 4096)) / 64
    return proto.SerializeToString()


@pytest.mark.parametrize("unigram", [False, True])
def test_ids_equal_the_library(unigram):
    data = serialised(unigram)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdethein  \n.,▁éß日") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    encoder, library = sp.Encoder(sp.Model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    offsets, ids = encoder.encode(texts)
    for i, expected in enumerate(library.encode(texts, num_threads=1)):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == expected, texts[i]
    assert encoder.decode(offsets, ids) == [t.replace("▁", " ") for t in texts]
    assert encoder.decode(np.array([0, 3]), np.array([1, 450, 2])) == [library.decode([1, 450, 2])]


def test_bounded_memories_change_nothing(monkeypatch):
    data = serialised(False)
    plain = sp.Encoder(sp.Model(data)).encode(TEXTS)
    monkeypatch.setattr(sp, "CACHE", 5)
    monkeypatch.setattr(sp, "PAIRS", 3)
    small = sp.Encoder(sp.Model(data))
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(plain, small.encode(TEXTS)))


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (5, TEXTS[5], "again")]
    df = spark.createDataFrame(rows, "doc_id int, text string, decoded string")
    encoded = sp.encode(df, PATH)
    out = sp.decode(encoded.withColumnRenamed("n_byte_ids", "decoded"), PATH).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sp.decode(sp.encode(df.limit(0), PATH), PATH).count() == 0
