"""Cross-tokenizer alignment by pointer jumping.

Each text is encoded by a byte-level BPE (A, of space + text) and by a piece model (B,
of the text; it puts the space before it itself).  Tokens are byte ranges.  Every token points
to the token that reaches farthest right among those it overlaps and itself (of
equal ends, to the A token); successor doubling over the whole block's pointers converges
to the last A token of each component, which labels its group.  Links are the
overlapping A-B pairs: the cells that the ends of both cut.

Neither tokenizer joins bytes across a single space between two non-blank characters
(checked for the piece model when it is read), so texts are cut there into units, and
each distinct unit of a block is encoded and aligned once; a bounded memory keeps
encoded units from block to block.  Blocks are some megabytes of text, cut where the rows
are.  A block writes its documents (with the units they are made of) and one row of its
distinct (A id, B id) pairs with their number of links.  Pairs are summed over the
corpus, each pair learns whether it is its B id's most frequent, and every block
gets its own pairs back: what is shuffled are distinct pairs per block and unit
numbers, never texts or tokens, and a group is one block.

Defined results: null and empty texts, and texts whose A or B bytes differ from space +
text (the piece model maps U+2581 to a space, for instance), have no tokens:
zeros and an empty ``groups_sha256``.  Repeated rows count each time; a very long
text is a block of its own; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import blocks, column
from .storage import materialise

BLOCK = 4 << 20         # text bytes of a block, about
CACHE = 150_000         # units remembered in a Python worker (twice, at most)
RUN = 2_000             # units encoded as one text
LONG_UNIT = 200         # characters; longer units are not remembered
SHIFT = 20              # B ids are below 2 ** SHIFT: a pair is A id << SHIFT | B id
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoders:
    """Both tokenizers with the byte strings of their ids."""

    def __init__(self, byte_bpe: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        # byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = json.loads(byte_bpe)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # units may be cut before a space only if no piece runs across it
        self.cuts = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64)
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def _one(self, unit: str) -> tuple[bytes, bytes]:
        data = (" " + unit).encode()
        a, b = self.a.encode(" " + unit, add_special_tokens=False).ids, self.b.encode(unit)
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return b"", b""
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def _run(self, run: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of units that neither start nor end with a blank, encoded as one text."""
        text = " ".join(run)
        data = (" " + text).encode()
        stops = np.cumsum([len(u.encode()) + 1 for u in run])
        sides = []
        for ids, strings, sizes in ((self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.a_bytes, self.a_size),
                                    (self.b.encode(text), self.b_bytes, self.b_size)):
            if b"".join([strings[i] for i in ids]) != data:
                return [self._one(u) for u in run]
            ids = np.array(ids, "<u4")
            ends = np.cumsum(sizes[ids])
            cuts = np.searchsorted(ends, stops)
            if (ends[cuts] != stops).any():
                return [self._one(u) for u in run]
            line, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            sides.append([line[s:e] for s, e in zip(at[:-1], at[1:])])
        return list(zip(*sides))

    def encode(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian uint32) of every unit in A and B; both empty where the bytes
        of either differ from the unit's."""
        known, short = {}, []
        for u in units:
            ids = self.new.get(u)
            if ids is None:
                ids = self.old.get(u)
            if ids is not None:
                known[u] = ids
            elif self.cuts and len(u) <= LONG_UNIT and u and not u[0].isspace() and not u[-1].isspace():
                short.append(u)
            else:
                known[u] = self._one(u)
        for at in range(0, len(short), RUN):
            run = short[at:at + RUN]
            known.update(zip(run, self._run(run)))
        if len(self.new) + len(short) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update((u, known[u]) for u in short[:CACHE])
        return [known[u] for u in units]


_ENCODERS: dict[int, Encoders] = {}


def _encoders(files: tuple[str, bytes]) -> Encoders:
    key = zlib.crc32(files[1], zlib.crc32(files[0].encode()))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoders(*files)
    return _ENCODERS[key]


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B token, tokens given by their ends on one
    line of bytes that both cover from 0 to the same last end."""
    n = len(a_ends)
    # the farthest-reaching token of the other side that overlaps is the one over the last byte
    over_a = np.searchsorted(b_ends, a_ends, "left")
    over_b = np.searchsorted(a_ends, b_ends, "left")
    own = np.arange(n)
    point = np.concatenate([np.where(b_ends[over_a] > a_ends, n + over_a, own), over_b])   # a B token never outreaches the A token over its last byte
    while True:
        far = point[point]
        if np.array_equal(far, point):
            break
        point = far
    ends = np.unique(point[:n])
    label = np.searchsorted(ends, point)
    return label[:n], label[n:]


def _digit_table() -> tuple[np.ndarray, np.ndarray]:
    text = np.char.zfill(np.arange(100_000).astype(str), 5)
    digits = np.frombuffer("".join(text.tolist()).encode(), np.uint8).reshape(-1, 5)
    return digits, np.maximum(1, np.char.str_len(np.arange(100_000).astype(str)))


class Alignment:
    """Units of a block, aligned together.

    Per unit: number of A tokens, B tokens, groups and links, the text of its groups
    (``a1,a2|b1;a3|b2``), and its links as pair codes."""

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, encoders: Encoders, encoded: list[tuple[bytes, bytes]]):
        a, b = (np.frombuffer(b"".join(e[side] for e in encoded), "<u4").astype(np.int64) for side in (0, 1))
        self.n_a, self.n_b = (np.fromiter((len(e[side]) for e in encoded), np.int64, len(encoded)) // 4 for side in (0, 1))
        a_ends, b_ends = np.cumsum(encoders.a_size[a]), np.cumsum(encoders.b_size[b])
        in_a, in_b = group_labels(a_ends, b_ends) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        unit_a = np.repeat(np.arange(len(encoded)), self.n_a)
        groups = int(in_a[-1]) + 1 if len(a) else 0
        unit_of_group = np.zeros(groups, np.int64)
        unit_of_group[in_a] = unit_a
        self.n_groups = np.bincount(unit_of_group, minlength=len(encoded)) if groups else np.zeros(len(encoded), np.int64)
        cells = np.union1d(a_ends, b_ends)
        link_a, link_b = np.searchsorted(a_ends, cells, "left"), np.searchsorted(b_ends, cells, "left")
        self.pairs = a[link_a] << SHIFT | b[link_b]
        self.unit_of_link = unit_a[link_a] if len(a) else np.zeros(0, np.int64)
        self.n_links = np.bincount(self.unit_of_link, minlength=len(encoded)) if len(a) else np.zeros(len(encoded), np.int64)
        self.texts = self._group_texts(a, b, in_a, in_b, unit_a)

    def _group_texts(self, a, b, in_a, in_b, unit_a) -> list[bytes]:
        if not len(a):
            return [b""] * len(self.n_a)
        if Alignment._tables is None:
            Alignment._tables = _digit_table()
        digits, widths = Alignment._tables
        # tokens in the order group, side, place; each with the mark that follows it
        group, side = np.concatenate([in_a, in_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        mark = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
        if ids.max() < len(digits):
            width = widths[ids]
            cells = np.hstack([digits[ids], mark[:, None]])
            shown = np.hstack([np.arange(5)[None] >= 5 - width[:, None], np.ones((len(ids), 1), bool)])
            line, sizes = cells[shown].tobytes(), width + 1
        else:                                       # vocabularies beyond five digits
            parts = [b"%d%c" % (i, m) for i, m in zip(ids.tolist(), mark.tolist())]
            line, sizes = b"".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.concatenate([unit_a, np.repeat(np.arange(len(self.n_b)), self.n_b)])[order]
        stops = np.concatenate([[0], np.cumsum(np.bincount(unit, weights=sizes, minlength=len(self.n_a)).astype(np.int64))]).tolist()
        return [line[s:e] for s, e in zip(stops[:-1], stops[1:])]


_TABLE = ("block long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, "
          "unit_pairs binary, unit_links binary, pairs array<long>, links array<long>")


def _align_blocks(docs: DataFrame, byte_bpe_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per document, and one per block (``pairs`` set) with its pairs."""
    with open(byte_bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    schema = _TABLE.format(id=picked.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encoders, number = _encoders(files.value), TaskContext.get().partitionId() << 32
        for part, texts in blocks(batches, "__text", BLOCK):
            index: dict[str, int] = {}
            at = index.setdefault
            codes, ends = [], [0]
            for text in texts.to_pylist():
                if text:
                    codes += [at(u, len(index)) for u in encoders.units(text)]
                ends.append(len(codes))
            encoded = encoders.encode(list(index))
            del index
            found = Alignment(encoders, encoded)
            code, ends = np.array(codes, np.int64), np.array(ends, np.int64)
            del codes, encoded
            broken = np.concatenate([[0], np.cumsum(found.n_a[code] == 0)])[ends]
            whole = np.diff(broken) == 0
            # units of documents without tokens are left out everywhere
            code = code[np.repeat(whole, np.diff(ends))]
            ends = np.concatenate([[0], np.cumsum(np.where(whole, np.diff(ends), 0))])

            def summed(values):
                return np.diff(np.concatenate([[0], np.cumsum(values[code])])[ends])

            texts_of, digests, units = found.texts, [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
                mine = code[s:e]
                digests.append(hashlib.sha256(b"".join([texts_of[c] for c in mine.tolist()])[:-1]).hexdigest() if e > s else "")
                units.append(mine.astype("<u4").tobytes())
            n = part.num_rows
            nulls = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), column(part, "doc_id"), *(pa.array(summed(v)) for v in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                 pa.array(digests, pa.string()), pa.array(units, pa.binary()), nulls, nulls, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            seen = np.bincount(code, minlength=len(found.n_a))
            pairs, place = np.unique(found.pairs, return_inverse=True)
            links = np.bincount(place, weights=seen[found.unit_of_link], minlength=len(pairs)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
            whole_row = [[number], [None], *[[0]] * 4, [None], [None], [place.astype("<u4").tobytes()], [found.n_links.astype("<u4").tobytes()], [pairs], [links]]
            types = [pa.int64(), column(part, "doc_id").type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(whole_row, types)], names=names)
            number += 1

    return picked.mapInArrow(run, schema)


def align(docs: DataFrame, byte_bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = materialise(_align_blocks(docs, byte_bpe_path, piece_path, id_col, text_col), "aligned")
    per_block = table.where("pairs IS NOT NULL")
    lists = per_block.select("block", F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "p"))
    used = lists.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    totals = materialise(used.where("links > 0").groupBy("pair").agg(F.sum("links").alias("total")), "pair-totals")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # one row per B id: bounded by the vocabulary
    tops = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("top"))
    judged = totals.withColumn("b_id", b_id).join(F.broadcast(tops), "b_id").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    counted = used.select(F.col("block").alias("of_block"), "place", "pair").join(judged, "pair").select("of_block", "place", "total", "best")
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(rows: pa.Table, counts: pa.Table) -> pa.Table:
        shared = rows.filter(pc.is_valid(rows["unit_pairs"]))
        mine = rows.filter(pc.is_null(rows["unit_pairs"]))
        place = np.frombuffer(shared["unit_pairs"][0].as_py(), "<u4").astype(np.int64)
        per_unit = np.frombuffer(shared["unit_links"][0].as_py(), "<u4").astype(np.int64)
        sums = []
        stops = np.concatenate([[0], np.cumsum(per_unit)])
        for name in ("best", "total"):
            value = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
            value[counts["place"].to_numpy()] = counts[name].to_numpy().astype(np.int64)
            sums.append(np.diff(np.concatenate([[0], np.cumsum(value[place])])[stops]))
        units = mine["units"].combine_chunks()
        out = [[], []]
        for u in units:
            codes = np.frombuffer(u.as_py(), "<u4")
            for to, values in zip(out, sums):
                to.append(int(values[codes].sum()) if len(codes) else 0)
        return pa.table([mine["doc_id"], *(mine[c] for c in names[1:5]), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), mine["groups_sha256"]], names=names)

    kept = table.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "unit_pairs", "unit_links")
    return kept.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(
        finish, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
