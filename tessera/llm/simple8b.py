"""Simple-8b coding of unsigned integers, vectorised.

A 64-bit word has a 4-bit selector on top and a fixed count of equally wide
values below, the first value lowest. Selector 0 is an escape: its word holds
the place of one value of 60 bits or more in a table of raw values. Words do
not cross blocks of ``BLOCK`` values, and a table of the blocks' first words
lets any block be decoded alone, or all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: Values per word and bits per value, by selector from 1; selector 0 is the escape.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120], np.int64)
BITS = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
_LIMITS = np.array([1 << int(b) for b in BITS[1:]], np.uint64)
#: For values under 65,536: the highest selector whose width holds them.
_LEVEL = (15 - np.searchsorted(_LIMITS[::-1], np.arange(1 << 16, dtype=np.uint64), side="right")).astype(np.uint8)


def _levels(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < 1 << 16:
        return _LEVEL[values]
    return (15 - np.searchsorted(_LIMITS[::-1], values, side="right")).astype(np.uint8)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block (blocks + 1 entries), raw values.

    At each place the selector with the most values that fit is taken, as far
    as the block goes.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // block)
    level = np.full(blocks * block, 255, np.uint8)
    level[:n] = _levels(values)
    inside = (level != 255).reshape(blocks, block)
    level = level.reshape(blocks, block)
    best = np.where(inside & (level >= 1), 1, 0).astype(np.uint8)
    for s in range(2, 16):
        fits = inside & (level >= s)
        if not fits.any():
            break
        width, want = 1, int(COUNTS[s])
        while width < want and fits.shape[1] > 0:  # AND over windows by doubling
            step = min(width, want - width)
            fits = fits[:, :-step] & fits[:, step:]
            width += step
        if fits.size:
            best[:, : fits.shape[1]][fits] = s
    at, starts, rows = np.zeros(blocks, np.int64), np.zeros(blocks * block, bool), np.arange(blocks)
    size = np.minimum(block, n - rows * block)
    while len(rows):  # all blocks step from word to word together
        place = rows * block + at
        starts[place] = True
        at = at + COUNTS[best.ravel()[place]]
        on = at < size
        rows, at, size = rows[on], at[on], size[on]
    first = np.flatnonzero(starts)
    chosen = best.ravel()[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            continue
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            words[mine] |= values[first[mine] + j] << np.uint64(BITS[s] * j)
    escapes = np.flatnonzero(chosen == 0)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64)
    return words, np.searchsorted(first, np.arange(blocks + 1) * block).astype(np.uint32), values[first[escapes]]


def unpack(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """All values of consecutive words."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    count = COUNTS[selector]
    to = np.cumsum(count)
    out = np.zeros(int(to[-1]) if len(to) else 0, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        place, word = to[mine] - count[mine], words[mine]
        if s == 0:
            out[place] = raw[(word & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            out[place + j] = (word >> np.uint64(BITS[s] * j)) & mask
    return out


def unpack_block(words: np.ndarray, blocks: np.ndarray, raw: np.ndarray, which: int) -> np.ndarray:
    """The values of one block."""
    return unpack(words[blocks[which]: blocks[which + 1]], raw)
