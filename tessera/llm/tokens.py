"""Token ids of whole texts by a public byte-level BPE file, with a cache of pieces.

A byte-level BPE splits a text into pieces (words, digits, punctuation, white
space; a space goes with what follows it) before it merges. Texts are cut, all
at once with numpy, at places that are borders of pieces whatever stands
around them; each distinct cutting is encoded once by the tokenizers library
and its ids are copied to every place where it occurs. The ids are those of
the library for the whole text, called without settings of ours: the string of an
added token (such as ``<|endoftext|>``) is that token wherever it stands in a text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textops

#: Cuttings held by a worker's cache; a full one starts anew.
CACHE = 800_000

# classes of bytes: other, white space, letter, digit, punctuation, apostrophe
_O, _W, _L, _N, _P, _A = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _W
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _L
_CLASS[0x30:0x3A] = _N
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = _P
_CLASS[0x27] = _A

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    """The byte-level BPE of 50,257 ids in the folder of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where cuttings begin, documents' starts included.

    A border is: letters, digits, punctuation and apostrophes against each
    other (but what follows an apostrophe may be a contraction, and an
    apostrophe joins punctuation before it); the start of white space; a space
    before something else; and what follows one white space character that is
    no space. Next to bytes of unknown characters only sure borders are taken.
    """
    n = len(buf)
    c = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    c[lead] = c[lead + 1] = _L
    known = c >= _L
    cut = np.zeros(n + 1, bool)
    if n > 1:
        a, b = c[:-1], c[1:]
        cut[1:n] = known[:-1] & (a != _A) & (a != b) & (b != _O) & ~((a == _P) & (b == _A))
        cut[1:n] |= (a == _A) & (b == _W)
        cut[1: n - 1] |= (buf[1:-1] == 0x20) & known[2:]
        cut[2:n] |= (a[1:] == _W) & (buf[1:-1] != 0x20) & known[:-2] & known[2:]
        after = np.flatnonzero((buf[:-1] == 0x20) & known[1:]) + 1  # the space goes with what follows
        cut[after] = False
    edge = off[:-1]
    cut[edge] = True
    # a document's end: what white space it has there, and what looks across documents
    inner = edge[(edge > 0) & (edge < n)]
    for k in (1, 2):
        near = inner - k
        near = near[(near >= 0)]
        odd = near[(c[near] == _W)]
        cut[odd[~np.isin(odd, edge)]] = False
        head = inner + k
        head = head[head < n]
        odd = head[c[head] != _W] if k == 1 else head[c[head - 1] == _W]
        cut[odd[(c[odd - 1] == _W) & ~np.isin(odd, edge)]] = False
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.limit = Tokenizer.from_file(path), cache
        added = self.model.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Added tokens that only part a text where they stand; others are left to the library.
        self.parting = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=lambda c: (-len(c), c)))) + ")") if self.added else None
        (self.feed,) = self.model.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of cuttings, with each one's place and size in them. Those without white space but a first space go
        through the library together, parted by line feeds: the id of a line
        feed stands nowhere else then, and parts the ids again."""
        plain = [i for i, x in enumerate(pieces) if "\n" not in x and x[:2] != "  " and x.strip() == x.lstrip(" ") != ""]
        size, order, found = np.zeros(len(pieces), np.int64), [], []
        for at in range(0, len(plain), 20_000):
            some = plain[at: at + 20_000]
            ids = self.whole(["\n".join(["", *(pieces[i] for i in some)])])[0]
            feeds = np.flatnonzero(ids == self.feed)
            size[some] = np.diff(np.append(feeds, len(ids))) - 1
            order += some
            found.append(ids[ids != self.feed])
        seen = set(plain)
        rest = [i for i in range(len(pieces)) if i not in seen]
        for i, x in zip(rest, self.whole([pieces[i] for i in rest]), strict=True):
            size[i] = len(x)
            order.append(i)
            found.append(x)
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.zeros(0, "<u4"), *found]), start, size

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, start, size = self._encode(pieces)
        start = start + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, place, keys), np.insert(self.start, place, start), np.insert(self.size, place, size)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids back to back and len + 1 offsets; ``end`` closes each text. Null is empty."""
        if not self.added or not any(pc.any(pc.match_substring(texts, c)).as_py() for c in self.added):
            return self._plain(texts, end)
        parts = [self.marks.split(t) if t else [""] for t in texts.to_pylist()]  # text, added token, text, ...
        if self.parting:
            ids, off = self._plain(pa.array([x for p in parts for x in p[::2]], pa.string()))
        else:
            parts = [["".join(p)] for p in parts]
            found = self.whole([p[0] for p in parts])
            ids, off = np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        out, bounds, k = [], [0], 0
        for p in parts:
            for i, x in enumerate(p):
                if i % 2:
                    out.append(np.array([self.added[x]], "<u4"))
                else:
                    out.append(ids[off[k]: off[k + 1]])
                    k += 1
            if end is not None:
                out.append(np.array([end], "<u4"))
            bounds.append(bounds[-1] + sum(map(len, out[-(len(p) + (end is not None)):])))
        return np.concatenate([np.zeros(0, "<u4"), *out]), np.array(bounds, np.int64)

    def _plain(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without added tokens."""
        buf, off = textops.flat(texts)
        tail = 0 if end is None else 1
        if not len(buf):
            return np.full(tail * len(texts), end or 0, "<u4"), np.arange(len(texts) + 1) * tail
        start = cuts(buf, off)
        start = start[start < len(buf)]
        stop = np.append(start[1:], len(buf))
        keys = textops.word_keys(buf, start, stop)
        own, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, own)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != own if len(self.keys) else np.ones(len(own), bool))
        if len(new):
            data = buf.tobytes()
            self._learn(own[new], [data[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, own)
        size = self.size[at][which]
        index, _, _ = textops.inner(self.start[at][which], self.start[at][which] + size)
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[np.searchsorted(start, off)]
        if not tail:
            return self.pool[index], bounds
        out = np.full(len(index) + len(texts), end, "<u4")
        bounds = bounds + np.arange(len(texts) + 1)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = self.pool[index]
        return out, bounds


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int = 0) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """For batches of (doc_id, text): doc_ids, all ids with the end ids, and offsets."""
    own = encoder(path)
    for batch in textops.sliced(batches, size=2 << 20):
        yield batch.column(0).to_pylist(), *own.encode(batch.column(1), end)
