"""Vectorised text helpers for Arrow batches: flat bytes, word spans, word keys.

A batch of texts is one byte buffer with document offsets; words are spans in
it. Every helper works on whole buffers with numpy, no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Space and the control characters 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20_240_607)
_BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back and len + 1 offsets; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A to Z in lower case, every other byte as it is."""
    return buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)


def spans(buf: np.ndarray, off: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its
    first word (len + 1 entries). ``parts``: which bytes part words; a
    document's end always does."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~parts[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def inner(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans: the index of every byte in them, its place within its span,
    and where each span begins in that list."""
    size = end - start
    head = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(head, size)
    return np.repeat(start, size) + at, at, head


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span's bytes (a polynomial over keyed bytes, mixed
    with the length)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    index, at, head = inner(start, end)
    power = np.ones(int(at.max()) + 1, np.uint64)
    power[1:] = _STEP
    power = np.multiply.accumulate(power)
    total = np.add.reduceat(_BYTE_KEY[buf[index]] * power[at], head)
    return mix(total ^ ((end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and about so many bytes of text; a single
    longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run begins, and how long it is."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return head, np.diff(np.r_[head, len(keys)])


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as a string column. Spans must begin and end between characters."""
    index, _, _ = inner(start, end)
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[index])))
