"""Secret scans through a trigram inverted index.

Every rule is a byte regex.  A Boolean query over trigrams is derived from it
(``trigram_query``): the trigrams that any match must contain.  A block of
documents (an index segment of a few MB, built where the rows are) gets an
inverted index of the trigrams the rules ask for: trigram -> sorted documents.
The query of a rule intersects and unites postings; only the candidates are
verified with the regex.  A rule without mandatory trigrams (a run of hex
digits) scans every document fully.  Postings are case-folded, so they are a
superset for case-sensitive rules.

Spans are (kind, start, end) in code points, end exclusive, leftmost
non-overlapping per kind; a match that fails its rule's length is dropped.

Defined results: null and empty texts have no spans; repeated rows each get
their result; no prefix or cap applies to long texts; an empty table gives an
empty result; other columns are not read by ``find_secrets`` and pass unchanged
through ``redact_secrets``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import blocks, buffers, column


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    group: int = 0          # the group whose length counts
    min_length: int = 0     # in bytes; the classes that count are ASCII
    ignore_case: bool = False

    def compiled(self):
        return re.compile(self.pattern, re.IGNORECASE if self.ignore_case else 0)


# The three base rules of the contract.
BASE_RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]{16,}"),  # maximal runs of 16 or more
)
# Well-known public credential formats.
ADDED_RULES = (
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", rb"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", ignore_case=True),
    Rule("url_login", rb"[a-z]{2,10}://[^\s/:@]*:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + ADDED_RULES

# ---- Boolean trigram queries -------------------------------------------------
# True = no mandatory trigram; bytes = one trigram; ("and" | "or", [queries]).

_MAX_STRINGS = 64


def _both(queries):
    parts = [q for q in queries if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _either(queries):
    return True if not queries or any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", list(queries))


def _of_strings(strings):
    """Query of a finite set of substrings one of which must occur."""
    return _either([_both([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes):
    """(finite set of exact strings or None, query) of a sequence of nodes."""
    queries, exact, whole = [], {b""}, True

    def close():
        nonlocal exact, whole
        queries.append(_of_strings(exact))
        exact, whole = {b""}, False

    for op, arg in nodes:
        if op is sre.LITERAL:
            strings, query = {bytes([arg]).lower()}, True
        elif op is sre.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is sre.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            strings = set().union(*(s for s, _ in branches)) if all(s is not None for s, _ in branches) else None
            query = _either([_both([q, _of_strings(s)]) if s is not None else q for s, q in branches])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            strings, query = {bytes([a]).lower() for _, a in arg}, True
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            if (low, high) == (0, 1) and inner is not None:
                strings, query = inner | {b""}, True
            else:
                strings = None
                query = (_both([query, _of_strings(inner)]) if inner is not None else query) if low else True
        elif op is sre.AT:
            continue
        else:
            strings, query = None, True
        if strings is None or len(exact) * len(strings) > _MAX_STRINGS:
            close()
            queries.append(query)
            if strings is not None:
                exact = set(strings)
        else:
            exact = {a + b for a in exact for b in strings}
            if query is not True and not strings:
                queries.append(query)
    if whole:
        return exact, _both(queries)
    close()
    return None, _both(queries)


def trigram_query(pattern: bytes):
    """Boolean query of case-folded trigrams that every match of ``pattern``
    satisfies, or True where none is mandatory."""
    strings, query = _walk(sre_parser.parse(pattern))
    return _both([query, _of_strings(strings)]) if strings is not None else query


def trigrams_of(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings (sorted row numbers) of the wanted trigrams in one block."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.slot = np.zeros(1 << 24, np.uint16)  # 0: not wanted
        for i, t in enumerate(wanted):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, offsets: np.ndarray, raw: np.ndarray) -> dict[bytes, np.ndarray]:
        empty = dict.fromkeys(self.wanted, np.zeros(0, np.int64))
        if len(raw) < 3:
            return empty
        low = self.fold[raw].astype(np.uint32)
        slots = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(slots)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        n = len(offsets)
        pairs = np.unique((slots[at[inside]].astype(np.int64) - 1) * n + row[inside])
        which, rows = pairs // n, pairs % n
        cuts = np.searchsorted(which, np.arange(len(self.wanted) + 1))
        return {t: rows[cuts[i]:cuts[i + 1]] for i, t in enumerate(self.wanted)}


def evaluate(query, postings) -> np.ndarray:
    """Candidate rows of a query that is not True."""
    if isinstance(query, bytes):
        return postings[query]
    parts = sorted((evaluate(q, postings) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    """Rules with their queries; finds spans block by block."""

    def __init__(self, rules):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules))))

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """row -> spans (start, rule number, end) in bytes, ordered."""
        offsets, raw = buffers(texts)
        postings = self.index.postings(offsets, raw)
        found: dict[int, list] = {}
        data = memoryview(raw)
        for k, (rule, regex, query) in enumerate(self.rules):
            rows = range(len(texts)) if query is True else evaluate(query, postings).tolist()
            for row in rows:
                for m in regex.finditer(data[offsets[row]:offsets[row + 1]]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                        found.setdefault(row, []).append((m.start(), k, m.end()))
        return {row: sorted(s) for row, s in found.items()}


def code_points(text: bytes, at: list[int]) -> dict[int, int]:
    """Byte offset -> code-point offset, for offsets on character borders."""
    out, seen, before = {}, 0, 0
    for b in sorted(set(at)):
        seen += len(text[before:b].decode("utf-8", "replace"))
        out[b], before = seen, b
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) for every row, ordered
    by start, then rule."""
    def scan(batches):
        scanner = Scanner(rules)
        for part, texts in blocks(batches, "__text"):
            found = scanner.spans(texts)
            raw_off, raw = buffers(texts)
            out = []
            for row in range(len(texts)):
                spans = found.get(row)
                if not spans:
                    out.append([])
                    continue
                points = code_points(raw[raw_off[row]:raw_off[row + 1]].tobytes(), [x for a, _, b in spans for x in (a, b)])
                out.append([{"kind": scanner.rules[k][0].kind, "start": points[a], "end": points[b]} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([column(part, "__id"), pa.array(out, _SPANS)], names=["__id", "spans"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    id_type = picked.schema["__id"].dataType.simpleString()
    return (picked.mapInArrow(scan, f"__id {id_type}, spans array<struct<kind string, start bigint, end bigint>>")
            .withColumnRenamed("__id", id_col))


def redact_secrets(docs: DataFrame, text_col: str = "text", rules=RULES, mark: str = "[{kind}]") -> DataFrame:
    """All rows and columns, in ``docs``' schema, with every secret in
    ``text_col`` replaced by its mark; overlapping spans become one mark, of
    the first span's kind.  Null texts stay null."""
    schema = docs.schema

    def scrub(batches):
        scanner = Scanner(rules)
        for part, texts in blocks(batches, text_col):
            found = scanner.spans(texts)
            i = part.schema.get_field_index(text_col)
            if found:
                off, raw = buffers(texts)
                new = column(part, text_col).to_pylist()
                for row, spans in found.items():
                    text, out, at = raw[off[row]:off[row + 1]].tobytes(), [], 0
                    for start, k, end in spans:
                        if start >= at:
                            out += [text[at:start], mark.format(kind=scanner.rules[k][0].kind).encode()]
                        at = max(at, end)
                    new[row] = b"".join([*out, text[at:]]).decode("utf-8", "replace")
                part = part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))
            yield part

    return docs.mapInArrow(scrub, schema)
