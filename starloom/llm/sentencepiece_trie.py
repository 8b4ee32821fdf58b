"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut into marked words (leading blanks and the run after them) at
borders that no piece crosses.  The distinct words of a block are sorted, which
lays them out as a trie in depth-first order; the forward table of a prefix is
computed once and reused by every word that continues it.

The forward entry of a prefix is, for unigram models, the best score and its
last piece.  For BPE models it is the last piece of the prefix's own
segmentation: of the pieces ending here, the one that the segmentation before
it joins without a merge across the border (decided by running the merges on
the two pieces alone, and remembered); adjacent pieces that hold pairwise hold
as a whole, so the result equals merging the whole word.  Ids equal those of
the SentencePiece library.  Characters without a piece fall back to bytes.

Defined results: null and empty texts have no ids and decode to an empty text;
the blank mark U+2581 in a text counts as a blank; repeated rows are encoded
each; long texts are encoded whole; an empty table gives an empty result; other
columns are not read by ``encode`` and pass unchanged through ``decode``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import blocks, column, gather_runs

MARK = "▁"
CACHE = 200_000
PAIRS = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """Pieces of a serialised model, blanks for marks."""

    def __init__(self, serialised: bytes):
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialised)
        self.bpe = proto.trainer_spec.model_type == 2
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (1, 2) or spec.precompiled_charsmap or spec.remove_extra_whitespaces \
                or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only plain unigram and BPE models without normalisation rules are read")
        self.prefix = " " if spec.add_dummy_prefix else ""
        pieces = [p.piece.replace(MARK, " ") for p in proto.pieces]
        self.ids = {s: i for i, (s, p) in enumerate(zip(pieces, proto.pieces)) if p.type == _NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = [0] * 256
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        surfaces = []
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                surfaces.append(bytes([int(p.piece[3:5], 16)]))
            else:
                surfaces.append(b"" if p.type == _CONTROL else " ⁇ ".encode() if p.type == _UNKNOWN else pieces[i].encode())
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.first_byte = min(self.bytes) if self.byte_fallback else 0
        self.surface_length = np.array([len(s) for s in surfaces], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        # lengths of the pieces that end in a character, longest first
        ends: dict[str, set[int]] = {}
        for s in self.ids:
            ends.setdefault(s[-1], set()).add(len(s))
        self.ends = {c: tuple(sorted(n, reverse=True)) for c, n in ends.items()}
        alphabet = set("".join(self.ids))
        if any(re.search(r"[^ ] ", s) for s in self.ids):
            self.words = re.compile(r"(?s).+")         # pieces cross words: texts are single words
        else:
            hard = "".join(re.escape(c) for c in "\n\r\t" if c not in alphabet)
            self.words = re.compile(rf" *[^ {hard}]+| +" + (f"|[{hard}]" if hard else ""))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10

    # ---- forward tables: lists indexed by prefix length ----

    def _merged(self, text: str) -> list[str]:
        """BPE merges on a short string: best score first, leftmost on ties."""
        symbols, ids, scores = list(text), self.ids, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols


class Encoder:
    """Word encoder with bounded memories; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _joins(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            merged = self.model._merged(left + right)
            known = self.pairs[left, right] = merged == ([left, right] if left else [right])
        return known

    def _extend_bpe(self, word: str, table: list[str], at: int) -> None:
        """Last piece of ``word[:at]``'s segmentation."""
        pairs, ids = self.pairs, self.model.ids
        for n in self.model.ends.get(word[at - 1], ()):
            if n <= at:
                piece = word[at - n:at]
                if piece in ids:
                    before = table[at - n]
                    known = pairs.get((before, piece))
                    if known or (known is None and self._joins(before, piece)):
                        table.append(piece)
                        return
        table.append(word[at - 1])                     # no piece for the character

    def _extend_unigram(self, word: str, table: list[tuple[float, str]], at: int) -> None:
        """Best score of ``word[:at]`` and its last piece; ties go to the longer piece."""
        model, best, last = self.model, -np.inf, ""
        for n in model.ends.get(word[at - 1], ()):
            if n <= at:
                i = model.ids.get(word[at - n:at])
                if i is not None and table[at - n][0] + model.scores[i] > best:
                    best, last = table[at - n][0] + model.scores[i], word[at - n:at]
        if word[at - 1] not in model.ids and table[at - 1][0] + model.unknown_score > best:
            best, last = table[at - 1][0] + model.unknown_score, word[at - 1]
        table.append((best, last))

    def _ids(self, pieces: list[str]) -> bytes:
        model, out = self.model, []
        for p in pieces:
            i = model.ids.get(p)
            if i is not None:
                out.append(i)
            elif model.byte_fallback:
                out += [model.bytes[b] for b in p.encode()]
            else:
                out.append(model.unknown)
        return np.array(out, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: sorted, walked as a trie in depth-first order."""
        known = {}
        for w in words:
            ids = self.new.get(w)
            if ids is None:
                ids = self.old.get(w)
            if ids is not None:
                known[w] = ids
        bpe = self.model.bpe
        extend = self._extend_bpe if bpe else self._extend_unigram
        table: list = ["" if bpe else (0.0, "")]
        previous = ""
        for word in sorted(w for w in words if w not in known):
            shared, limit = 0, min(len(previous), len(word))
            while shared < limit and previous[shared] == word[shared]:
                shared += 1
            del table[shared + 1:]
            for at in range(shared + 1, len(word) + 1):
                extend(word, table, at)
            pieces, at = [], len(word)
            while at:
                piece = table[at] if bpe else table[at][1]
                pieces.append(piece)
                at -= len(piece)
            known[word] = self._ids(pieces[::-1])
            previous = word
        if len(self.new) + len(known) > CACHE:
            self.old, self.new = self.new, {}
        if len(known) <= CACHE:
            self.new.update(known)
        return [known[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        index: dict[str, int] = {}
        number = index.setdefault
        find, prefix = self.model.words.findall, self.model.prefix
        codes, ends = [], [0]
        for text in texts:
            if text:
                codes += [number(w, len(index)) for w in find(prefix + text.replace(MARK, " "))]
            ends.append(len(codes))
        parts = self.encode_words(list(index))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(lengths) - lengths
        code = np.array(codes, np.int64)
        per_word = lengths[code]
        total = np.concatenate([[0], np.cumsum(per_word)])
        return total[np.array(ends)], flat[gather_runs(starts[code], per_word)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of the id sequences ``ids[offsets[i]:offsets[i + 1]]``."""
        model = self.model
        lengths = model.surface_length[ids]
        step = 500_000                                  # ids per gather, to bound memory
        data = b"".join(model.surface[gather_runs(model.surface_start[ids[a:a + step]], lengths[a:a + step])].tobytes()
                        for a in range(0, len(ids), step))
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text.removeprefix(model.prefix) if model.prefix else text)
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(serialised: bytes) -> Encoder:
    key = zlib.crc32(serialised)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Model(serialised))
    return _ENCODERS[key]


def _shared_model(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, ids array<int>, n_byte_ids, ids_crc32 of the
    little-endian unsigned 32-bit ids) of every row."""
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    model = _shared_model(docs, model_path)

    def run(batches):
        encoder = _encoder(model.value)
        first, last = encoder.model.first_byte, encoder.model.first_byte + 256
        is_byte = np.zeros(len(encoder.model.surface_length), np.int64)
        if encoder.model.byte_fallback:
            is_byte[first:last] = 1
        for part, texts in blocks(batches, "__text"):
            offsets, ids = encoder.encode(texts.to_pylist())
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [column(part, "__id"), column(part, "__text"),
                 pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)),
                 pa.array(np.diff(bytes_before[offsets]), pa.int64()),
                 pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())],
                names=["__id", "__text", "ids", "n_byte_ids", "ids_crc32"])

    id_type = picked.schema["__id"].dataType.simpleString()
    out = picked.mapInArrow(run, f"__id {id_type}, __text string, ids array<int>, n_byte_ids long, ids_crc32 long")
    return out.withColumnsRenamed({"__id": id_col, "__text": text_col})


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and ``out_col``, the text of the ids; null ids are empty."""
    model = _shared_model(encoded, model_path)
    kept = encoded.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        encoder = _encoder(model.value)
        for b in batches:
            ids = column(b, ids_col)
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            texts = encoder.decode(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), ids.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)
