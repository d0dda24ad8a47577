"""Toxicity: a learnt lexicon, matched with Levenshtein automata, in context.

Terms are words that occur in toxic rows of a bounded labelled sample far more
often than in others, counted by their different neighbours; beginnings that
many such words share are stems. Terms form a trie. A batch's distinct words walk through
it together: each word's state at a node is its row of edit distances to the
node's prefix (an automaton that accepts words within the term's distance, a swap
of neighbours being one edit), words whose row exceeds the distance leave, and those
left at a term's node match it. A term of four letters or more allows one edit, one of
eight or more two. A misspelled term counts like the term, less a fixed part: its
sign is not fitted, as few labelled rows have one. Words that the sample has in clean
rows are harmless, and a term with many harmless neighbours is matched exactly.

Each match is read in its context: inside a quotation (the marks may stand anywhere
in the paragraph) or after words of reporting it counts as quoted, near words of
address as aimed at someone. A logistic model over those counts, fitted on the
sample, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textops
from .langid import remainder
from .quality import labelled

#: Labelled rows used for training at most, by hash order of doc_id.
TRAINING_ROWS = 20_000
#: Letters of a stem: a beginning that many terms share, after which any ending matches.
STEM = (4, 5, 6)
#: Words on either side of a match that are its window.
WINDOW = 4
THRESHOLD = 0.3
#: Letters of a term from which one edit is allowed, and two.
EDIT_FROM, EDITS_FROM = 4, 8
#: A misspelled term counts as this part of the term.
MISSPELLED = 0.9
#: A term is matched exactly if it has more harmless words near it than one, and one more for so many of its places.
CROWDED = 10
#: Toxic share of a term's places and of a stem's.
TERM_SHARE, STEM_SHARE = 0.9, 0.5

#: Bytes that part words: ASCII but letters, digits; others belong to words.
_PARTS = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])

# Words of reporting and of address, in the languages of the corpus.
REPORTING = "said says called quoted quote word term sagte sagt nannte wort dijo dice llamó palabra dit disait appelé mot".split()
ADDRESS = "you your youre u du dich dir ihr euch sie tú te usted ustedes eres tu toi vous es".split()


def _keys(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    end = np.cumsum(size)
    return textops.word_keys(np.frombuffer(b"".join(data), np.uint8), end - size, end)


def allowed(letters: int) -> int:
    """Edits that a term of so many letters allows."""
    return 0 if letters < EDIT_FROM else 1 if letters < EDITS_FROM else 2


_WIDE = 2  # the most edits: a word's state is the diagonal and as many neighbours on each side


class Trie:
    """Terms as a trie: children by character, the term that ends at a node, and
    the most edits that a term below it allows. ``exact``: terms that allow none."""

    def __init__(self, terms: list[str], exact: set[str] = frozenset()):
        self.terms, self.children, self.ends, self.reach = terms, [{}], [-1], [0]
        self.edits = [0 if t in exact else allowed(len(t)) for t in terms]
        self.longest = max(map(len, terms), default=0) + _WIDE
        for i, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.edits[i])
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], self.edits[i])
            self.ends[node] = i

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the nearest term within its distance and that distance; -1 and 9 for none."""
        term, best = np.full(len(words), -1), np.full(len(words), 9)
        exact = {t: i for i, t in enumerate(self.terms)}
        for i, w in enumerate(words):
            if w in exact:
                term[i], best[i] = exact[w], 0
        fuzzy = np.array([i for i, w in enumerate(words) if best[i] and EDIT_FROM - 1 <= len(w) <= self.longest], np.int64)
        if not len(fuzzy) or not self.reach[0]:
            return term, best
        width = self.longest + 1
        chars = np.zeros((len(fuzzy), width + _WIDE), np.uint32)
        size = np.zeros(len(fuzzy), np.int64)
        for row, i in enumerate(fuzzy):
            code = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[row, : len(code)], size[row] = code, len(code)
        start = np.array([9] * _WIDE + list(range(_WIDE + 1)), np.int8)
        stack = [(0, 0, np.arange(len(fuzzy)), np.tile(start, (len(fuzzy), 1)), None, 0)]
        while stack:
            node, depth, rows, now, before, last = stack.pop()
            for ch, child in self.children[node].items():
                if not self.reach[child]:
                    continue
                c = ord(ch)
                new = np.full((len(rows), 2 * _WIDE + 1), 9, np.int8)
                for k in range(2 * _WIDE + 1):
                    j = depth + 1 + k - _WIDE  # letters of the word read at this state
                    if j < 0:
                        continue
                    cost = now[:, k + 1] + 1 if k < 2 * _WIDE else np.full(len(rows), 9, np.int8)  # the term's letter is extra
                    if k > 0:
                        cost = np.minimum(cost, new[:, k - 1] + 1)  # the word's letter is extra
                    if j > 0:
                        cost = np.minimum(cost, now[:, k] + (chars[rows, j - 1] != c))
                    if before is not None and j > 1:
                        swap = (chars[rows, j - 2] == c) & (chars[rows, j - 1] == last)
                        cost = np.where(swap, np.minimum(cost, before[:, k] + 1), cost)
                    new[:, k] = np.minimum(cost, 9)
                alive = new.min(axis=1) <= self.reach[child]
                if not alive.any():
                    continue
                own, state = rows[alive], new[alive]
                if (end := self.ends[child]) >= 0 and self.edits[end]:
                    gap = size[own] - (depth + 1) + _WIDE
                    fits = (gap >= 0) & (gap <= 2 * _WIDE)
                    found = np.full(len(own), 9)
                    found[fits] = state[fits, gap[fits]]
                    nearer = (found < best[fuzzy[own]]) | ((found == best[fuzzy[own]]) & (end < term[fuzzy[own]]))
                    hit = np.flatnonzero((found <= self.edits[end]) & nearer)
                    best[fuzzy[own[hit]]], term[fuzzy[own[hit]]] = found[hit], end
                stack.append((child, depth + 1, own, state, now[alive], c))
        return term, best


class Lexicon:
    """Terms with weights, stems, words known to be harmless though near a term, terms matched
    exactly, and a cache of the words met: their weight and distance by word key (-1: a stem)."""

    def __init__(self, terms: dict[str, float], harmless: set[str] = frozenset(), stems: dict[str, float] | None = None, exact: set[str] = frozenset()):
        self.stems = dict(sorted((stems or {}).items()))
        self.terms = sorted(terms)
        self.weights = np.array([terms[t] for t in self.terms])
        self.harmless, self.exact = sorted(harmless), sorted(exact)
        self._ready = False

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "terms": self.terms, "weights": self.weights, "harmless": self.harmless, "exact": self.exact, "_ready": False}

    def _prepare(self) -> None:
        self.trie, self.safe = Trie(self.terms, set(self.exact)), frozenset(self.harmless)
        self.keys, self.weight, self.edits = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int8)
        self.report, self.address = np.sort(_keys(REPORTING)), np.sort(_keys(ADDRESS))
        self._ready = True

    def look(self, keys: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Weight (0 for none) and distance of distinct keys; ``words(i)`` gives the words of indexes."""
        if not self._ready:
            self._prepare()
        if len(self.keys) > 1_000_000:
            self.keys, self.weight, self.edits = self.keys[:0], self.weight[:0], self.edits[:0]
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            fresh = words(new)
            term, edits = self.trie.match(fresh)
            safe = np.fromiter((0 < d < 9 and w in self.safe for w, d in zip(fresh, edits.tolist(), strict=True)), bool, len(fresh))
            term[safe] = -1
            weight = np.where(term >= 0, self.weights[term] if len(self.terms) else 0.0, 0.0)
            for i in np.flatnonzero(edits > 0).tolist() if self.stems else ():
                known = max((self.stems.get(fresh[i][:k], 0.0) for k in STEM if len(fresh[i]) > k), default=0.0)
                if known:
                    weight[i], edits[i] = known, -1
            self.keys, self.weight, self.edits = (np.insert(self.keys, at[new], keys[new]), np.insert(self.weight, at[new], weight), np.insert(self.edits, at[new], edits.astype(np.int8)))
            at = np.searchsorted(self.keys, keys)
        return self.weight[at], self.edits[at]

    def spot(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """All matches of a batch: doc, word (its place), weight, edits (-1: by a stem), quoted, aimed; and words per text."""
        if not self._ready:
            self._prepare()
        raw, off = textops.flat(pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.string()))
        start, end, first = textops.spans(raw, off, _PARTS)
        words = np.diff(first)
        keys = textops.word_keys(raw, start, end)
        own, at, which = np.unique(keys, return_index=True, return_inverse=True)
        data = raw.tobytes()
        weight, edits = self.look(own, lambda i: [data[a:b].decode(errors="replace") for a, b in zip(start[at[i]].tolist(), end[at[i]].tolist(), strict=True)])
        hit = np.flatnonzero(weight[which] > 0)
        doc = np.searchsorted(first, hit, side="right") - 1
        quoted, aimed = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
        for n, (i, d) in enumerate(zip(hit.tolist(), doc.tolist(), strict=True)):
            a, b = max(first[d], i - WINDOW), min(first[d + 1], i + WINDOW + 1)
            quoted[n] = bool(np.isin(keys[a:i], self.report).any())
            aimed[n] = bool(np.isin(np.r_[keys[a:i], keys[i + 1: b]], self.address).any())
        for d in np.unique(doc).tolist():
            a, b = np.array(quotations(data[off[d]: off[d + 1]]), np.int64).reshape(-1, 2).T + off[d]
            mine = np.flatnonzero(doc == d)
            k = np.searchsorted(a, start[hit[mine]]) - 1  # the last quotation that begins before the match
            quoted[mine] |= (k >= 0) & (start[hit[mine]] < b[np.maximum(k, 0)]) if len(a) else False
        return {"doc": doc, "word": hit - first[doc], "weight": weight[which][hit], "edits": edits[which][hit], "quoted": quoted, "aimed": aimed, "words": words}


_MARKS = re.compile('"|“|”|„|«|»|\n[ \t\r]*\n'.encode())


def quotations(text: bytes) -> list[tuple[int, int]]:
    """Where quotations begin and end in a text: between two straight marks, or from an opening
    mark to its closing one. A quotation ends within its paragraph or is none, so that a stray
    mark turns nothing round that follows an empty line. They do not overlap, and come in order."""
    out: list[tuple[int, int]] = []
    opened: tuple[str, int] | None = None
    for m in _MARKS.finditer(text):
        mark = m[0].decode()
        if mark[0] == "\n":
            opened = None
        elif opened is None:
            opened = None if mark in "”»" else (mark, m.start())
        elif mark in {'"': '"', "“": "”“", "„": "“”", "«": "»"}[opened[0]]:
            out.append((opened[1], m.start()))
            opened = None
    return out


def inputs(lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
    """Per text, of matches that are not quoted unless said: log counts of terms (a misspelled one counts
    less), of quoted ones and of aimed ones, the strongest log odds, the log sum of weights, terms a
    word (its root), log count of stems, stems a word (its root)."""
    x, n = lexicon.spot(texts), len(texts)
    part = np.where(x["edits"] > 0, MISSPELLED, 1.0)
    term, stem = ~x["quoted"] & (x["edits"] >= 0), ~x["quoted"] & (x["edits"] < 0)
    count = lambda flags, w=part: np.bincount(x["doc"][flags], w[flags], n)
    strongest = np.zeros(n)
    odds = np.log(np.maximum(x["weight"], 0.5) / np.maximum(1 - x["weight"], 1e-3))
    np.maximum.at(strongest, x["doc"][term], (odds * part)[term] / 3)
    words = np.maximum(x["words"], 1)
    return np.stack([np.log1p(count(term)), np.log1p(count(x["quoted"])), np.log1p(count(x["aimed"] & term)), strongest, np.log1p(count(term, x["weight"] * part)),
                     np.sqrt(count(term) / words), np.log1p(count(stem)), np.sqrt(count(stem) / words)], axis=1)


#: What each input should mean before any label is seen.
_PRIOR = np.array([0.5, 0.0, 0.2, 1.0, 0.5, 2.0, 0.5, 3.0])
#: Inputs that may not speak against toxicity, whatever the sample says: terms, aimed ones, stems.
_NOT_BELOW = np.array([0.2, -np.inf, 0.0, 0.5, 0.2, 0.0, 0.0, 0.0])


class Model:
    def __init__(self, lexicon: Lexicon, weight: np.ndarray = _PRIOR, bias: float = -3.0):
        self.lexicon, self.weight, self.bias = lexicon, weight, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(self.lexicon, texts) @ self.weight + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic model that leans towards _PRIOR, no weight below _NOT_BELOW
    (one that would go below stays there, and the others are solved for)."""
    a = np.c_[x, np.ones(len(x))]
    centre, least = np.r_[_PRIOR, -3.0], np.r_[_NOT_BELOW, -np.inf]
    w, ridge = centre.copy(), l2 * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        up = a.T @ (y - p) - ridge * (w - centre)
        free = (w > least + 1e-12) | (up > 0)
        f = a[:, free]
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(f.T @ (f * (p * (1 - p))[:, None]) + ridge * np.eye(f.shape[1]), up[free])
        new = np.maximum(w + move * min(1.0, 2.0 / max(1e-9, np.abs(move).max())), least)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def fit(training: DataFrame) -> Model:
    """A model from a bounded number of (doc_id, text, y) rows. Without toxic rows: an empty lexicon, low scores."""
    spark = training.sparkSession
    common.small_batches(spark)
    rows = common.written(training.select("doc_id", "text", "y"), "toxic-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches, size=2 << 20):
            raw, off = textops.flat(pa.array([t.lower() if t else "" for t in batch.column(0).to_pylist()], pa.string()))
            start, end, first = textops.spans(raw, off, _PARTS)
            keys, doc = textops.word_keys(raw, start, end), np.repeat(np.arange(len(off) - 1), np.diff(first))
            beside = np.zeros(len(keys) + 2, np.uint64)
            beside[1:-1] = keys
            around = textops.mix(beside[:-2] * np.uint64(3) + beside[2:])
            around[first[:-1][first[:-1] < len(keys)]] ^= np.uint64(1)  # a first word has nothing before it
            y = np.array([v or 0 for v in batch.column(1).to_pylist()], np.int32)[doc]
            yield pa.RecordBatch.from_arrays([textops.strings(raw, start, end), pa.array(around.view(np.int64)), pa.array(y)], names=["word", "around", "y"])

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Model(Lexicon({}), bias=-4.0)
    # a word counts once for each pair of neighbours, so that copies of a passage count once
    seen = rows.select("text", "y").mapInArrow(words, "word string, around long, y int").groupBy("word", "around").agg(F.max("y").alias("y"))
    counts = common.written(seen.groupBy("word").agg(F.sum("y").cast("long").alias("toxic"), F.sum(1 - F.col("y")).cast("long").alias("clean")), "word-counts")
    sums = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count("*").alias("words")).first()
    if not sums["t"]:
        return Model(Lexicon({}), bias=-4.0)
    # evidence: log-likelihood ratio of a word's share of toxic places against the share of all
    share = sums["t"] / (sums["t"] + sums["c"])
    t, c = F.col("toxic"), F.col("clean")
    ratio = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / max(1e-9, 1 - share))).otherwise(0.0)
    ahead = math.log(max(2, sums["words"])) + 2
    good = counts.filter("toxic >= 3 and length(word) >= 3").withColumn("evidence", ratio).filter((F.col("evidence") > ahead) & (t / (t + c) >= TERM_SHARE))
    strong = good.collect()  # every one, of a bounded sample's words
    stems: dict[str, float] = {}
    for k in STEM:
        by_stem = (counts.filter(F.length("word") > k).groupBy(F.substring("word", 1, k).alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words"))
                   .filter("words >= 5 and toxic >= 5").withColumn("evidence", ratio).filter((F.col("evidence") > ahead) & (t / (t + c) >= STEM_SHARE)))
        for r in by_stem.collect():
            if not any(r["stem"].startswith(x) for x in stems):
                stems[r["stem"]] = r["toxic"] / (r["toxic"] + r["clean"] + 1)
    weights = {r["word"]: r["toxic"] / (r["toxic"] + r["clean"] + 1) for r in strong}
    if not weights and not stems:
        return Model(Lexicon({}), bias=-4.0)
    # words near a term that are met in clean rows at least as often as in toxic ones: known to be harmless
    trie_terms = spark.sparkContext.broadcast(sorted(weights))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(trie_terms.value)
        for batch in batches:
            term, edits = trie.match(batch.column(0).to_pylist())
            at = np.flatnonzero((edits > 0) & (edits < 9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([trie.terms[i] for i in term[at].tolist()], pa.string())], names=["word", "term"])

    beside = counts.filter((F.col("clean") > 0) & (F.col("clean") >= F.col("toxic"))).select("word").mapInArrow(near, "word string, term string").collect()
    around: dict[str, int] = {}
    for r in beside:
        around[r["term"]] = around.get(r["term"], 0) + 1
    lexicon = Lexicon(weights, {r["word"] for r in beside}, stems, {r["word"] for r in strong if around.get(r["word"], 0) - 1 > r["toxic"] / CROWDED})
    shared = spark.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches, size=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(inputs(shared.value, batch.column(0))), pa.list_(pa.float64()))], names=["y", "x"])

    seen = rows.select("text", "y").mapInArrow(measured, "y int, x array<double>").toArrow()
    x, y = np.array(seen.column("x").to_pylist()).reshape(-1, len(_PRIOR)), seen.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return Model(lexicon, *_logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted.

    Null and empty texts have no match and the model's lowest score. lang,
    source and other columns are never read. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches, size=2 << 20):
            p = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.documents_columns(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def matches(docs: DataFrame, model: Model) -> DataFrame:
    """One row per matched word: doc_id, word (its place from 0), weight, edits, quoted, aimed."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches, size=2 << 20):
            x = shared.value.spot(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x["doc"])), pa.array(x["word"]), pa.array(x["weight"], pa.float64()), pa.array(x["edits"].astype(np.int32)), pa.array(x["quoted"]), pa.array(x["aimed"])],
                                             names=["doc_id", "word", "weight", "edits", "quoted", "aimed"])

    return common.documents_columns(docs).mapInArrow(run, "doc_id long, word long, weight double, edits int, quoted boolean, aimed boolean")


def annotate(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Fits on labelled rows with remainder(4) <> 2 and scores all: doc_id, held_out, score, predicted."""
    model = fit(labelled(docs, labels, "toxic", rows, remainder(4) != 2))
    return score(docs, model).withColumn("held_out", remainder(4) == 2)
