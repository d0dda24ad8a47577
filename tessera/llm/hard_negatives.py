"""Hard-negative mining with Kronecker-packed integer products.

Vectors are quantised to integers. In a block of candidates the same component
of several of them is biased to be no less than zero and packed into separated
fields of one 64-bit integer; one multiplication by an anchor's component then
advances the scores of all of them. The fields are as wide as the largest score
that the data can give (Cauchy-Schwarz over measured norms) asks for, so the
unpacked scores are exact.

Rows and anchors are dealt into groups of bounded size, and every pair of groups
meets once in a cogroup: the stated query set against all rows, in blocks.
Nothing is broadcast. The first meeting finds the best same-label rows of each
anchor, scoring rows of that label only; the second finds, for each positive's
band of scores, the best rows of other labels. Each group hands on its own best
few, and a window over those chooses the last.

Defined cases: rows with a null label, a null vector or a component that is
null, NaN or infinite take no part. A shorter vector counts as filled up with
zeros. Rows of one vec_id are rows of their own, each its own anchor; a row with a null
vec_id is no anchor and comes after all others in ties. Vectors whose scores could
pass 2^62 raise an error. Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows and anchors of a group; groups are smaller (down to LEAST_ROWS) where that gives every core work.
GROUP_ROWS, GROUP_ANCHORS, LEAST_ROWS = 1 << 16, 1 << 13, 1 << 10
#: Anchors scored at a time against packed words.
STEP_CELLS = 1 << 18
SCALE = 256
U64 = np.uint64


def quantised(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, vec (floor of ``scale`` times each component) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(sound)
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return kept.select("vec_id", label.cast("long").alias("label"), whole.alias("vec")).withColumn("row", F.monotonically_increasing_id())


# ---- packed products ---------------------------------------------------------------------

class Packed:
    """Candidates [n, d] packed into 64-bit words of ``fields`` fields, ``width`` bits each."""

    def __init__(self, vectors: np.ndarray, most: int):
        self.n = len(vectors)
        self.width = max(2, int(2 * most + 1).bit_length())  # a score in [-most, most], moved up by most
        self.fields = max(1, 64 // self.width)
        self.most = most
        words = -(-self.n // self.fields)
        self.bias = max(0, -int(vectors.min(initial=0)))
        biased = np.zeros((words * self.fields, vectors.shape[1]), U64)
        biased[: self.n] = (vectors + self.bias).astype(U64)
        split = biased.reshape(words, self.fields, -1)
        shifts = (np.arange(self.fields, dtype=U64) * U64(self.width))[None, :, None]
        self.words = np.ascontiguousarray((split << shifts).sum(axis=1, dtype=U64).T)  # [d, words]
        self.ones = U64(sum(1 << (i * self.width) for i in range(self.fields)))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products [anchors, n] of rows of ``anchors`` [a, d]. The sums run modulo
        2^64; taking the bias away leaves them in [-most, most] a field, and ``most`` more makes
        each field no less than zero, so no field borrows from the next."""
        a = anchors.astype(np.int64)
        total = np.zeros((len(a), self.words.shape[1]), U64)
        factor = a.astype(U64)
        for k in range(a.shape[1]):
            total += factor[:, k: k + 1] * self.words[k][None, :]
        away = (U64(self.most) - (U64(self.bias) * a.sum(axis=1).astype(U64))) * self.ones
        total += away[:, None]
        mask = U64((1 << self.width) - 1) if self.width < 64 else ~U64(0)
        out = np.empty((len(a), self.words.shape[1], self.fields), np.int64)
        for i in range(self.fields):
            out[:, :, i] = ((total >> U64(i * self.width)) & mask).astype(np.int64) - self.most
        return out.reshape(len(a), -1)[:, : self.n]


def _vectors(table: pa.Table, size: int) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(table), size), np.int64)
    if len(table) and (lengths == size).all():
        return values.reshape(-1, size).copy()
    row = np.repeat(np.arange(len(table)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _by_id(table: pa.Table) -> pa.Table:
    """Sorted by vec_id, null last, then row: equal scores are taken in this order."""
    return table.sort_by([("vec_id", "ascending"), ("row", "ascending")])


def _positives(size: int, most: int, many: int):
    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            rows = _by_id(rows)
            v, label, row = _vectors(rows, size), rows.column("label").to_numpy(), rows.column("row").to_numpy()
            av, alabel, arow = _vectors(anchors, size), anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            order = np.argsort(label, kind="stable")
            names, head = np.unique(label[order], return_index=True)
            for name, at, to in zip(names, head, [*head[1:], len(label)], strict=True):
                asked = np.flatnonzero(alabel == name)
                if not len(asked):
                    continue
                own = order[at:to]
                packed = Packed(v[own], most)
                step = max(1, STEP_CELLS // packed.words.shape[1])
                for some in (asked[i: i + step] for i in range(0, len(asked), step)):
                    s = packed.scores(av[some])
                    s[arow[some][:, None] == row[own][None, :]] = -most - 1  # the anchor itself comes last
                    best = np.argsort(-s, axis=1, kind="stable")[:, : many + 1]
                    r = np.repeat(np.arange(len(some)), best.shape[1])
                    c = best.ravel()
                    good = (s[r, c] >= -most) & (np.tile(np.arange(best.shape[1]), len(some)) < many)
                    out.append((some[r[good]], own[c[good]], s[r, c][good]))
        a, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        take = lambda t, n, i: t.column(n).combine_chunks().take(pa.array(i))
        return pa.table({"anchor": take(anchors, "row", a), "anchor_id": take(anchors, "vec_id", a), "positive_id": take(rows, "vec_id", c), "row": take(rows, "row", c), "score": pa.array(s, pa.int64())})

    return run


def _negatives(size: int, most: int, many: int, low: int, high: int):
    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            rows = _by_id(rows)
            v, label = _vectors(rows, size), rows.column("label").to_numpy()
            av, alabel = _vectors(anchors, size), anchors.column("label").to_numpy()
            bands = [[(p["slot"], p["score"]) for p in x] for x in anchors.column("positives").to_pylist()]
            packed = Packed(v, most)
            step = max(1, STEP_CELLS // packed.words.shape[1])
            for first in range(0, len(av), step):
                s = packed.scores(av[first: first + step])
                for i, own in enumerate(s, first):
                    # low * p <= 100 * s <= high * p holds for no s where p < 0
                    limits = [(slot, -(-low * p // 100), high * p // 100) for slot, p in bands[i] if p >= 0]
                    if not limits:
                        continue
                    near = np.flatnonzero((own >= min(x[1] for x in limits)) & (own <= max(x[2] for x in limits)) & (label != alabel[i]))
                    near = near[np.argsort(-own[near], kind="stable")]
                    falling = -own[near]
                    for slot, a, b in limits:
                        at, to = np.searchsorted(falling, -b, "left"), np.searchsorted(falling, -a, "right")
                        got = near[at: min(to, at + many)]
                        if len(got):
                            out.append((np.full(len(got), i), np.full(len(got), slot), got, own[got]))
        a, p, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        take = lambda t, n, i: t.column(n).combine_chunks().take(pa.array(i))
        return pa.table({"anchor": take(anchors, "row", a), "slot": pa.array(p, pa.int32()), "negative_id": take(rows, "vec_id", c), "row": take(rows, "row", c), "score": pa.array(s, pa.int64())})

    return run


# ---- the operator ------------------------------------------------------------------------

def _dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
    """Rows with a group of their own, once for each group of the other side (columns
    renamed to themselves, as both sides of a cogroup come from one table)."""
    mine = df.select(*[F.col(c).alias(c) for c in df.columns]).withColumn(own, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _group_count(rows: int, parts: int, most: int, least: int) -> int:
    return max(1, -(-rows // most), min(4 * parts, rows // least))


def mine(rows: DataFrame, *, label: Column | None = None, anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = SCALE, group_rows: int = GROUP_ROWS, group_anchors: int = GROUP_ANCHORS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label. ``anchor`` tells which rows are
    anchors (all by default), ``label`` gives the label to use. Per anchor the
    first ``positives`` rows of its label, and per positive the first
    ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    all_ = common.written(quantised(rows, label if label is not None else F.col("label"), scale), "quantised")
    is_anchor = anchor if anchor is not None else F.lit(True)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, n_anchors, size, square = all_.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("vec")), F.max(norm)).first()
    most, size = int((square or 0.0) * (1 + 1e-9)) + 1, max(1, size or 1)
    if most >= 1 << 62:
        raise ValueError("scores could pass 2^62: use a smaller scale")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g, h = _group_count(n, parts, group_rows, least_rows), max(1, -(-n_anchors // group_anchors))
    asked = all_.filter(is_anchor)
    by = ["_rows", "_anchors"]
    candidates = _dealt(all_, "_rows", g, "_anchors", h).groupBy(*by)
    found = candidates.cogroup(_dealt(asked, "_anchors", h, "_rows", g).groupBy(*by)).applyInArrow(
        _positives(size, most, positives), "anchor long, anchor_id long, positive_id long, row long, score long")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last(), "row")
    top = common.written(found.withColumn("slot", F.row_number().over(best)).filter(F.col("slot") <= positives), "positives")
    bands = top.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("slot", "score")).alias("positives"))  # a few of each
    with_bands = asked.join(bands, "row")
    candidates = _dealt(all_, "_rows", g, "_anchors", h).groupBy(*by)
    hard = candidates.cogroup(_dealt(with_bands, "_anchors", h, "_rows", g).groupBy(*by)).applyInArrow(
        _negatives(size, most, negatives, low, high), "anchor long, slot int, negative_id long, row long, score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("negative_id").asc_nulls_last(), "row")
    ranked = hard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = ranked.select("anchor", "slot", "rank", "negative_id", F.col("score").alias("negative_score"))
    return out.join(top.select("anchor", "slot", "anchor_id", "positive_id", F.col("score").alias("positive_score")), ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, b.vec_id, b.r AS br, a.label = b.label AS same,
                      CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])), 0) AS BIGINT) AS score
               FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
         p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS k FROM s WHERE same) WHERE k <= 5),
         n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                      row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.br) AS rank
               FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
