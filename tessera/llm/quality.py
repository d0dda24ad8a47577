"""Quality classifier: a factorisation machine over hashed words and structure.

Inputs of a text are its distinct words, hashed into a fixed number of places
and weighted by their log counts at unit length, and standardised statistics
of its structure and size (what the text's metadata would say of it: length,
lines, words). All pairs of inputs interact through low-rank vectors; the
pairwise sum is evaluated in linear time as half the square of the sum less
the sum of squares. Training takes a bounded sample of labelled rows; scoring
is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textops
from .langid import remainder

#: Labelled rows used for training at most, by hash order of doc_id.
TRAINING_ROWS = 8_000
PLACES, RANK, EPOCHS = 1 << 14, 6, 6
STATISTICS = 16


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch: row pointers, places and values of the hashed words, and
    the statistics [text, STATISTICS] before standardising."""
    buf, off = textops.flat(texts)
    n_docs, size = len(texts), np.diff(off).astype(float)
    some = np.maximum(size, 1)
    totals = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])
    upper = totals((buf >= 65) & (buf <= 90)) / some
    digits = totals((buf >= 48) & (buf <= 57)) / some
    marks = totals(np.isin(buf, np.frombuffer(b"!?", np.uint8))) / some
    signs = totals(np.isin(buf, np.frombuffer(b"#$%&*@^~+=<>{}[]\\/_", np.uint8))) / some
    bars = totals(buf == ord("|")) / some
    stops = totals(np.isin(buf, np.frombuffer(b".,;:", np.uint8))) / some
    wide = totals(buf >= 128) / some
    lines = totals(buf == 10) + 1.0
    low = textops.lower_ascii(buf)
    start, end, first = textops.spans(low, off)
    words = np.diff(first).astype(float)
    any_words = np.maximum(words, 1)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    keys = textops.word_keys(low, start, end)
    length = (end - start).astype(float)
    mean = np.bincount(doc, length, n_docs) / any_words
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n_docs) / any_words - mean**2, 0))
    same = np.zeros(len(keys))
    same[1:] = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, same, n_docs) / any_words
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, np.int64)
    count, owner = np.diff(np.r_[head, len(k)]), d[head]
    distinct = np.bincount(owner, minlength=n_docs) / any_words
    top = np.zeros(n_docs)
    np.maximum.at(top, owner, count)
    place = (k[head] >> np.uint64(50)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value**2, n_docs))
    value = value / np.maximum(norm, 1e-9)[owner]
    rows = np.searchsorted(owner, np.arange(n_docs + 1))
    sized = lambda x: np.log1p(x)
    stats = np.stack([upper, digits, marks, signs, bars, stops, wide, sized(size), sized(words), sized(lines), mean, spread, repeats, distinct, top / any_words, words / lines / 100], axis=1)
    return rows, place, value, stats


class Model:
    """Weights and vectors of a factorisation machine over PLACES words and STATISTICS numbers."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = PLACES + STATISTICS
        self.bias, self.weight = 0.0, np.zeros(n)
        self.vectors = rng.normal(0, 0.05, (n, RANK))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def _inputs(self, feats: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, place, value, stats = feats
        z = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.5
        return rows, place, value, z

    def _parts(self, rows, place, value, z) -> tuple[np.ndarray, np.ndarray]:
        n = len(z)
        linear, total, squares = np.zeros(n), np.zeros((n, RANK)), np.zeros((n, RANK))
        full = np.flatnonzero(np.diff(rows))
        if len(full):
            at = rows[:-1][full]
            linear[full] = np.add.reduceat(self.weight[place] * value, at)
            v = self.vectors[place] * value[:, None]
            total[full] = np.add.reduceat(v, at, axis=0)
            squares[full] = np.add.reduceat(v**2, at, axis=0)
        dense = self.vectors[PLACES:]
        total += z @ dense
        squares += z**2 @ dense**2
        return self.bias + linear + z @ self.weight[PLACES:] + 0.5 * (total**2 - squares).sum(axis=1), total

    def score(self, feats: tuple) -> np.ndarray:
        raw, _ = self._parts(*self._inputs(feats))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, feats: tuple, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, seed: int = 5, l2: float = 1e-4) -> Model:
        """Adagrad over small batches; deterministic."""
        if not len(y):
            return self
        stats = feats[3]
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        rows, place, value, z = self._inputs(feats)
        g_w, g_v, g_b = np.full(len(self.weight), 1e-2), np.full(self.vectors.shape, 1e-2), 1e-2
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                pick = np.sort(order[at: at + 64])
                index, _, head = textops.inner(rows[pick], rows[pick + 1])
                own = np.append(head, len(index))
                p, x, zz = place[index], value[index], z[pick]
                raw, total = self._parts(own, p, x, zz)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
                doc = np.repeat(np.arange(len(pick)), np.diff(own))
                touched, which = np.unique(p, return_inverse=True)
                e = error[doc] * x
                step_w = np.concatenate([np.bincount(which, e, len(touched)), zz.T @ error])
                grad = e[:, None] * (total[doc] - self.vectors[p] * x[:, None])
                step_v = np.zeros((len(touched) + STATISTICS, RANK))
                for r in range(RANK):
                    step_v[: len(touched), r] = np.bincount(which, grad[:, r], len(touched))
                step_v[len(touched):] = zz.T @ (error[:, None] * total) - (zz**2 * error[:, None]).sum(axis=0)[:, None] * self.vectors[PLACES:]
                at_all = np.concatenate([touched, np.arange(PLACES, PLACES + STATISTICS)])
                step_w += l2 * self.weight[at_all]
                step_v += l2 * self.vectors[at_all]
                g_w[at_all] += step_w**2
                g_v[at_all] += step_v**2
                self.weight[at_all] -= rate * step_w / np.sqrt(g_w[at_all])
                self.vectors[at_all] -= rate * 0.3 * step_v / np.sqrt(g_v[at_all])
                g_b += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(g_b)
        return self


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: F.Column) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, by hash order of
    doc_id. Null labels are none; of several labels of a document the largest counts."""
    known = labels.filter(F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return common.documents_columns(docs).join(F.broadcast(some), "doc_id")


def fit(training: DataFrame) -> Model:
    """A model from (doc_id, text, y) rows, a bounded number of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches):
            rows, place, value, stats = features(batch.column(1))
            bounds = pa.array(rows.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(bounds, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32))),
                                              pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), STATISTICS).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "place", "value", "stats"])

    common.small_batches(training.sparkSession)
    got = training.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, place array<int>, value array<float>, stats array<double>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Model()
    lists = got.column("place").combine_chunks()
    feats = (lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64), got.column("value").combine_chunks().values.to_numpy().astype(float),
             got.column("stats").combine_chunks().values.to_numpy().reshape(-1, STATISTICS))
    return Model().fit(feats, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted.

    Null texts count as empty; an empty text is scored by its statistics. Without
    labelled rows every score is 0.5. Other columns, lang and source among them,
    are never read. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches, size=2 << 20):
            p = shared.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.documents_columns(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def annotate(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Fits on labelled rows with remainder(3) <> 1 and scores all: doc_id, held_out, score, predicted."""
    model = fit(labelled(docs, labels, "quality", rows, remainder(3) != 1))
    return score(docs, model).withColumn("held_out", remainder(3) == 1)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the documents that the classifier rejects. Rejected
    rows are found by doc_id; rows without a doc_id stay."""
    rejected = annotate(docs, labels, rows).filter("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return common.without_ids(docs, common.written(rejected, "rejected"))
