"""Arrow helpers shared by the operators whose tasks work on text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column by exact name (names may differ only by case)."""
    return batch.column(batch.schema.get_field_index(name))


def texts_of(col: pa.Array) -> pa.LargeStringArray:
    """Text column with nulls as empty strings, 64-bit offsets, no slice offset."""
    return pa.concat_arrays([pc.fill_null(col.cast(pa.large_string()), "")])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64[n+1], bytes uint8) of an unsliced large string / binary array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw[:offsets[-1]]


def blocks(batches, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut record batches into row ranges of about ``limit`` text bytes; a
    single longer text is a block of its own.  Rows are never split or lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            part = batch.slice(start, end - start)
            yield part, texts_of(column(part, text))
            start = end
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text.

    Returns (offsets, codes, vocabulary): the words of text i are
    ``vocabulary[codes[offsets[i]:offsets[i+1]]]``.  ``lower`` lower-cases
    A-Z only.  Splitting and dictionary encoding run in Arrow's kernels.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    encoded = lists.values.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty >= 0:  # empty strings beside leading and trailing blanks
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)[offsets]
        codes = codes[keep]
    return offsets, codes, encoded.dictionary


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def word_list(words: pa.Array) -> list[str]:
    """Python strings of blank-free words (one join and one split
    instead of a conversion per word)."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    out = pc.binary_join(one, pa.scalar(" ", words.type))[0].as_py().split(" ")
    return out if len(out) == len(words) else words.to_pylist()
