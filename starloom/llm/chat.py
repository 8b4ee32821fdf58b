"""Chat formatting by grammar round trip.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  A turn is rendered
as it is, reparsed by the deterministic parser below and compared with its
source; the field that conflicts is escaped (one more time) until the parser
recovers the turn exactly.  Text escaping puts a backslash between ``<`` and
``|`` (after the backslashes already there), role escaping is percent coding,
so both are reversible and untouched fields stay as they were.

A segment holds no control string but its own marks, so the concatenation of
segments parses into the concatenation of their turns.  Rendering and checking
run per row in parallel; only running offsets and digests go through a
conversation in order, streamed over sorted partitions with constant memory.

Defined results: null text or role is empty; null turns come first; equal turn
numbers are ordered by role, then formatted text; repeated rows are repeated turns; a
null conv_id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import column

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|[A-Za-z0-9_]+\|>")
_ROLE_UNSAFE = re.compile(r"[%<|\r\n]")


class GrammarError(ValueError):
    pass


def escape_text(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return _ROLE_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", role)


def unescape_role(role: str) -> str:
    return re.sub(r"%(25|3C|7C|0D|0A)", lambda m: chr(int(m[1], 16)), role)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: (role, text, start and end of the text as
    written).  Raises ``GrammarError`` where the grammar does not hold."""
    pos = 0
    while pos < len(formatted):
        if not formatted.startswith(START, pos):
            raise GrammarError(f"no turn at {pos}")
        role_at = pos + len(START)
        text_at = formatted.find("\n", role_at) + 1
        end = formatted.find(END, text_at)
        if not text_at or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise GrammarError(f"open turn at {pos}")
        role, text = formatted[role_at:text_at - 1], formatted[text_at:end]
        if CONTROL.search(role) or CONTROL.search(text):
            raise GrammarError(f"control string inside the turn at {pos}")
        yield unescape_role(role), unescape_text(text), text_at, end
        pos = end + len(END) + 1


def render(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn and the span of its text, escaped until it round-trips."""
    shown_role, shown_text = role, text
    for _ in range(3):
        segment = f"{START}{shown_role}\n{shown_text}{END}\n"
        try:
            turns = list(parse(segment))
        except GrammarError:
            turns = []
        if [t[:2] for t in turns] == [(role, text)]:
            return segment, turns[0][2], turns[0][3]
        role_ok = not CONTROL.search(shown_role) and "\n" not in shown_role and unescape_role(shown_role) == role
        text_ok = not CONTROL.search(shown_text) and unescape_text(shown_text) == text
        if not role_ok:
            shown_role = escape_role(role)
        if not text_ok:
            shown_text = escape_text(text)
    raise GrammarError("a turn does not round-trip")


_SEGMENTS = ("conv_id long, turn long, role string, segment string, loss_start long, loss_end long")


def _render_batches(batches):
    for b in batches:
        roles, texts = (column(b, c).to_pylist() for c in ("role", "text"))
        out = [render(r or "", t or "") for r, t in zip(roles, texts)]
        loss = [r == "assistant" for r in roles]
        yield pa.RecordBatch.from_arrays([
            column(b, "conv_id").cast(pa.int64()), column(b, "turn").cast(pa.int64()), pa.array([r or "" for r in roles], pa.string()),
            pa.array([o[0] for o in out], pa.string()),
            pa.array([o[1] if k else None for o, k in zip(out, loss)], pa.int64()),
            pa.array([o[2] if k else None for o, k in zip(out, loss)], pa.int64())],
            names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end"])


def _place_batches(batches):
    current, offset, index, first = None, 0, 0, True
    for b in batches:
        convs, segments = column(b, "conv_id").to_pylist(), column(b, "segment").to_pylist()
        offsets, indexes = [], []
        for conv, segment in zip(convs, segments):
            if first or conv != current:
                current, offset, index, first = conv, 0, 0, False
            offsets.append(offset)
            indexes.append(index)
            offset, index = offset + len(segment), index + 1
        placed = pa.array(offsets, pa.int64())
        shift = lambda name: pc.add(column(b, name), placed)
        yield pa.RecordBatch.from_arrays(
            [column(b, "conv_id"), pa.array(indexes, pa.int64()), column(b, "segment"), placed,
             shift("loss_start"), shift("loss_end")],
            names=["conv_id", "position", "segment", "offset", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations as ordered segments: conv_id, position (turn
    index), segment, offset (code points before it in its conversation),
    loss_start / loss_end (span of assistant text in the conversation, null
    for other roles).  Partitions hold whole conversations, in order."""
    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    segments = picked.mapInArrow(_render_batches, _SEGMENTS)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.mapInArrow(_place_batches, "conv_id long, position long, segment string, offset long, "
                                              "loss_start long, loss_end long")


def formatted_texts(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted) with whole conversations as one string each; for
    conversations that fit a row."""
    return (segments.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("position", "segment"))).alias("s"))
            .select("conv_id", F.array_join(F.col("s.segment"), "").alias("formatted")))


def _digest_batches(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def flush(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)], names=names)

    current, state, done = None, None, []
    for b in batches:
        base = column(b, "offset").to_pylist()
        for conv, segment, at, lo, hi in zip(column(b, "conv_id").to_pylist(), column(b, "segment").to_pylist(), base,
                                             column(b, "loss_start").to_pylist(), column(b, "loss_end").to_pylist()):
            if state is None or conv != current:
                if state:
                    done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if lo is not None:  # read through the loss mask
                text = unescape_text(segment[lo - at:hi - at])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(segment)
        if len(done) > 5000:
            yield flush(done)
            done = []
    if state:
        done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
    if done:
        yield flush(done)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_conversations``' output by the
    parser: turn count, digest of the turns, and of the text under the loss
    mask.  Streams over its partitions; needs their order kept."""
    return segments.mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                "loss_sha256 string, formatted_chars long")
