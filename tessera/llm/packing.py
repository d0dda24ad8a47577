"""Harmonic packing of documents into training sequences.

A document longer than a sequence gives whole sequences and a rest. A rest, or a
shorter document, of n ids belongs to the class of the reciprocal that it fits:
class k holds lengths in (capacity / (k + 1), capacity / k], and a bin of class k
takes exactly k of them, whatever else there is. Bins fill independently per
class and per task, in one pass, without a shuffle. Documents are not cut for
that. What a full bin lacks to the capacity is cut from one document at a time,
the donor; lacks below a 64th of the capacity are padded. What a task has
left at its end is packed one after the other, cut at the sequences' borders,
and the last of it into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

CAPACITY = 1024
#: A bin's lack below this part of the capacity is padding.
PADDED = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def class_of(n: int, capacity: int = CAPACITY) -> int:
    """The class of a length: as many of it fit a sequence."""
    return capacity // n


class Rest:
    """Ids of a document from ``start`` on; ``ids`` are a copy of these alone."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: np.ndarray, start: int, total: int):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, total

    def take(self, n: int) -> tuple:
        """The first n ids as a piece."""
        piece = (self.doc_id, self.start, n, zlib.crc32(self.ids[:n].tobytes()), self.total)
        self.ids, self.start = self.ids[n:], self.start + n
        return piece


class Bins:
    """One task's bins. Pieces go to ``out`` when their sequence is complete."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.least, self.next, self.out = capacity, max(1, capacity // PADDED), task << 40, []
        self.open: dict[int, list[Rest]] = {}
        self.lacking: deque[tuple[list[tuple], int]] = deque()  # full bins and what they lack
        self.donor: Rest | None = None

    def _sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.out.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document's ids (one at least)."""
        rest = Rest(doc_id, ids, 0, len(ids))
        if self.lacking and self.donor is None:
            self.donor = rest
            self._give()
            if not len(rest.ids):
                return
        while len(rest.ids) >= self.capacity:
            self._sequence([rest.take(self.capacity)])
        rest.ids = rest.ids.copy()
        if rest is self.donor or not len(rest.ids):
            self.donor = self.donor if len(rest.ids) else None if rest is self.donor else self.donor
            return
        k = class_of(len(rest.ids), self.capacity)
        held = self.open.setdefault(k, [])
        held.append(rest)
        if len(held) == k:
            self.open[k] = []
            lack = self.capacity - sum(len(r.ids) for r in held)
            pieces = [r.take(len(r.ids)) for r in held]
            if lack < self.least:
                self._sequence(pieces)
            else:
                self.lacking.append((pieces, lack))
                self._give()

    def _give(self) -> None:
        """Cut the donor for the bins that lack something."""
        while self.lacking and self.donor is not None:
            pieces, lack = self.lacking[0]
            n = min(lack, len(self.donor.ids))
            pieces.append(self.donor.take(n))
            if not len(self.donor.ids):
                self.donor = None
            if lack - n < self.least:
                self.lacking.popleft()
                self._sequence(pieces)
            else:
                self.lacking[0] = (pieces, lack - n)

    def finish(self) -> None:
        """All that is left: lacking bins first, then one document after the other."""
        left = deque([*([self.donor] if self.donor else []), *(r for k in sorted(self.open, reverse=True) for r in self.open[k])])
        self.donor, self.open = None, {}
        while self.lacking and left:
            self.donor = left.popleft()
            self._give()
        if self.donor is not None:
            left.appendleft(self.donor)
            self.donor = None
        for pieces, lack in self.lacking:  # at most one, of which the rest is padding
            self._sequence(pieces)
        self.lacking.clear()
        size = sum(len(r.ids) for r in left)
        while size:
            room = self.capacity if size >= self.capacity else 1 << (size.bit_length() - 1)
            size -= room
            pieces = []
            while room:
                n = min(room, len(left[0].ids))
                pieces.append(left[0].take(n))
                room -= n
                if not len(left[0].ids):
                    left.popleft()
            self._sequence(pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id; the string of an added token is that token. Each row of ``docs`` is packed, so
    repeated rows are packed each; a null doc_id stays null. sequence_id is the
    task's number in the upper bits and its count of sequences below. An empty
    table gives no rows; other columns play no part.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or tokens.default_path()
    common.small_batches(docs.sparkSession)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId())
        for doc_ids, ids, bounds in tokens.encoded(batches, path, end):
            for d, head, to in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                bins.add(d, ids[head:to])
            if len(bins.out) > 50_000:
                yield batch(bins.out)
                bins.out = []
        bins.finish()
        if bins.out:
            yield batch(bins.out)

    return common.documents_columns(docs).mapInArrow(run, SCHEMA)
