"""A minimal perfect hash of byte strings that keeps its keys.

Levels of bits (the cascade of Limasset et al., 2017): at each level the keys
still left are hashed to ``GAMMA`` times as many bits, and those alone on their
bit stay there; the rest go on to the next level. A key's slot is the number of
bits set before its own, so ``n`` keys have the slots 0 to n - 1. The keys
themselves are stored in slot order: a string that is no key is told from one
by comparing bytes, never by a hash alone.
"""

from __future__ import annotations

import numpy as np

from . import textops

U64 = np.uint64
GAMMA, LEVELS = 2, 24
_ODD = U64(0x9E3779B97F4A7C15)


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (textops.mix(keys + np.full(1, level + 1, U64) * _ODD) % U64(bits)).astype(np.int64)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether span i of buffer ``a`` holds the same bytes as span i of ``b``, both ``size[i]`` (over 0) long."""
    if not len(size):
        return np.zeros(0, bool)
    head = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(head, size)
    equal = a[np.repeat(a_start, size) + at] == b[np.repeat(b_start, size) + at]
    return np.logical_and.reduceat(equal, head)


class PerfectHash:
    """``bits``, ``before`` (slots of earlier levels) per level; ``data`` and ``ends``: the keys in slot order.
    Different strings with one 64-bit key end up in ``crowd``, a dictionary."""

    def __init__(self, sizes: np.ndarray, ranks: np.ndarray, data: np.ndarray, ends: np.ndarray):
        self.sizes, self.ranks, self.data, self.ends = sizes, ranks, data, ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n = len(ends)
        placed = int((ranks >= 0).sum())
        self.crowd = {self.key(i): i for i in range(placed, self.n)}

    @classmethod
    def build(cls, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> PerfectHash:
        """Of distinct, non-empty spans of ``buf``."""
        keys = textops.word_keys(buf, start, end)
        slot = np.full(len(keys), -1, np.int64)
        left, taken, sizes, ranks = np.arange(len(keys)), 0, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            bits = max(64, GAMMA * len(left))
            at = _place(keys[left], level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.where(alone, taken + np.cumsum(alone) - 1, -1).astype(np.int32)
            slot[left] = rank[at]
            taken += int(alone.sum())
            sizes.append(bits)
            ranks.append(rank)
            left = left[~alone[at]]
        slot[left] = np.arange(taken, len(keys))
        order = np.argsort(slot)
        index, _, _ = textops.inner(start[order], end[order])
        return cls(np.array(sizes, np.int64), np.concatenate(ranks) if ranks else np.zeros(0, np.int32), buf[index], np.cumsum((end - start)[order]))

    def key(self, slot: int) -> bytes:
        return self.data[self.starts[slot]: self.ends[slot]].tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that each 64-bit key would have, -1 where it can't be a key; not verified."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.sizes.tolist()):
            got = self.ranks[self.bases[level] + _place(keys[left], level, bits)]
            out[left] = got
            left = left[got < 0]
            if not len(left):
                break
        return out

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each span, -1 for spans that are no keys; every hit is verified against the stored key."""
        out = self.slots(keys)
        hit = np.flatnonzero(out >= 0)
        slot = out[hit]
        equal = (end - start)[hit] == (self.ends - self.starts)[slot]
        out[hit[~equal]] = -1
        hit, slot = hit[equal], slot[equal]
        out[hit[~same_bytes(buf, start[hit], self.data, self.starts[slot], (end - start)[hit])]] = -1
        if self.crowd:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.crowd.get(buf[start[i]: end[i]].tobytes(), -1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.ranks), self.n, len(self.data)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.sizes.astype("<i8"), self.ranks.astype("<i4"), self.data, self.ends.astype("<i8")))

    @classmethod
    def from_bytes(cls, payload: bytes) -> PerfectHash:
        levels, bits, n, size = np.frombuffer(payload, "<i8", 4).tolist()
        at, parts = 32, []
        for kind, many in (("<i8", levels), ("<i4", bits), ("u1", size), ("<i8", n)):
            parts.append(np.frombuffer(payload, kind, many, at))
            at += parts[-1].nbytes
        return cls(*parts)
