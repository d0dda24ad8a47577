"""LM scoring: a hierarchical Pitman-Yor model of words in context.

A token's context is the word before it. Each context is a restaurant; contexts
that end alike (the classes of the word's last two bytes, 1,024 in all) share a
parent, all parents share the root, and the root's base is uniform over the known
words and one unknown. Customers of a leaf are the tokens in that context, customers
of a parent are its children's tables. A context's number is its parent's and 20 bits
of the word's hash.

Counts are rows (word, context, n) from all training texts, gathered per word
by one shuffle. Given the restaurants' totals words are independent, so a Gibbs
sweep is a map over the words and a sum of totals: in it all customers of a word
leave and are seated again by the Chinese restaurant process, from the leaves to
the root, with the predictive probabilities of the seating before as odds of a new
table. Customers who come in at nearly the same odds are drawn together as one
binomial. Sweeps are replayed from the totals rather than stored. After the
burn-in, predictive probabilities are averaged over the sweeps.

Totals of root and parents are 1,025 numbers however large the corpus is; those of
contexts grow with it. A context with one customer has one table. Those of the others are
broadcast while they are within LEAF_BYTES, beyond that they are joined to the words.

(word, context) pairs that make up a fixed share of all tokens are broadcast, bounded
by that share, and scored where the texts are read; the rest meet the pairs' table
in one shuffle join. Pairs that training never saw, which only held-out texts
have, then meet the tables of words and of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textops
from .langid import remainder

#: Classes of a byte; parents are two of them; word contexts of a parent, by the word's hash.
KINDS = 32
PARENTS = KINDS * KINDS
CLASSES = 1 << 20
LEAVES = PARENTS * CLASSES
#: Sweeps in all, and how many of the first are burn-in; concentration of every restaurant.
SWEEPS, BURN_IN, CONCENTRATION = 3, 1, 1.0
#: Words and contexts, and pairs of both, with at least this share of all training tokens are broadcast (so many at most).
FREQUENT, FREQUENT_PAIRS = 8_000, 2_000_000
#: Bytes of the contexts' totals that are broadcast.
LEAF_BYTES = 128 << 20
#: Bits of a count beside its context.
COUNT = 33
#: Counts that a task gathers before it adds them up.
HELD = 4_000_000

# classes of bytes: a to z, digits, other, two of later and one of first bytes of other characters, a text's start
_CLASS = np.full(256, 27, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[128:192] = 28 + np.arange(64) % 2
_CLASS[192:] = 30
_START = 31

#: The end of a text, counted as a word.
END_KEY = np.uint64(0x5EEDED5EEDED5EED)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys and contexts of all tokens, each text's end included, and len + 1 offsets."""
    buf, off = textops.flat(texts)
    low = textops.lower_ascii(buf)
    start, end, first = textops.spans(low, off)
    docs, words = len(off) - 1, len(start)
    size = np.diff(first)
    doc = np.repeat(np.arange(docs), size)
    keys = np.full(words + docs, END_KEY, np.uint64)
    keys[np.arange(words) + doc] = textops.word_keys(low, start, end)
    context = np.full(words + docs, (_START * KINDS + _START) * CLASSES, np.int64)
    if words:
        second = np.where(end - start > 1, _CLASS[low[np.maximum(end - 2, 0)]], _START)
        slot = (keys[np.arange(words) + doc] >> np.uint64(44)).astype(np.int64)
        context[np.arange(words) + doc + 1] = (_CLASS[low[end - 1]] * KINDS + second) * CLASSES + slot
    return keys, context, first + np.arange(docs + 1)


def distinct(keys: np.ndarray, context: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (key, context) once, by key and context, with its count."""
    order = np.lexsort((context, keys))
    k, c = keys[order], context[order]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.r_[head, len(k)]) if n is None else np.add.reduceat(n[order], head) if len(k) else np.zeros(0, np.int64)
    return k[head], c[head], count


def tables(customers: np.ndarray, base: np.ndarray, discount: float, others: np.ndarray | float, rng: np.random.Generator, concentration: float = CONCENTRATION) -> np.ndarray:
    """Tables of each dish when its customers sit down one after another: the
    next opens one with odds (a + d T) p against i - d t. While a group of up
    to a tenth of those seated comes in, the odds are held."""
    t = np.minimum(customers, 1).astype(np.float64)
    seated = t.copy()
    pull = (concentration + discount * others) * np.maximum(base, 1e-300)
    pull = np.broadcast_to(pull, t.shape)
    on = np.flatnonzero(customers > 1)
    while len(on):
        group = np.minimum(np.maximum(1, seated[on] // 10), customers[on] - seated[on])
        odds = pull[on] / (pull[on] + np.maximum(seated[on] - discount * t[on], 1e-9))
        t[on] += rng.binomial(group.astype(np.int64), np.clip(odds, 0, 1))
        seated[on] += group
        on = on[seated[on] < customers[on]]
    return t


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, ascending, with the sums of its values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head, _ = textops.groups(key)
    return (key[head], *(np.add.reduceat(v[order], head) if len(key) else v for v in values))


class Contexts:
    """Customers and tables of word contexts by their number; those that are not here have one of each."""

    def __init__(self, ids: np.ndarray, customers: np.ndarray, tables: np.ndarray):
        self.ids, self.customers, self.tables = ids, customers, tables

    def at(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hit = found(self.ids, context)
        return (np.where(hit, x[at], 1.0) if len(x) else np.ones(len(at)) for x in (self.customers, self.tables))


class Beside(Contexts):
    """The same, already in the order of a seating's leaves."""

    def at(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.customers, self.tables


def found(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``ids``, and which of them hold."""
    at = np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
    return at, ids[at] == x if len(ids) else np.zeros(len(x), bool)


class Totals:
    """Customers and tables of all restaurants: root and parents (1 and 1,024 numbers each), and the contexts'."""

    SHAPE = (1, PARENTS)

    def __init__(self) -> None:
        self.customers = [np.zeros(n) for n in self.SHAPE]
        self.tables = [np.zeros(n) for n in self.SHAPE]
        self.ones, self.twos, self.tokens = np.zeros(3), np.zeros(3), np.zeros(1)
        self.leaf = Contexts(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def count(self, seats: Seating) -> None:
        """Add a seating to all but the contexts."""
        for k in range(2):
            self.customers[k] += np.bincount(seats.place[k], seats.customers[k], self.SHAPE[k])
            self.tables[k] += np.bincount(seats.place[k], seats.tables[k], self.SHAPE[k])
        for k in range(3):
            self.ones[k] += (seats.customers[k] == 1).sum()
            self.twos[k] += (seats.customers[k] == 2).sum()
        self.tokens += seats.customers[2].sum()

    def add(self, seats: Seating) -> None:
        self.count(seats)
        own = self.leaf
        self.leaf = Contexts(*_summed(np.append(own.ids, seats.place[2]), np.append(own.customers, seats.customers[2]), np.append(own.tables, seats.tables[2])))

    def flat(self) -> np.ndarray:
        return np.concatenate([*self.customers, *self.tables, self.ones, self.twos, self.tokens])

    @classmethod
    def of(cls, x: np.ndarray) -> Totals:
        out, cut = cls(), np.split(x, np.cumsum([*cls.SHAPE, *cls.SHAPE, 3, 3]))
        out.customers, out.tables, out.ones, out.twos, out.tokens = cut[:2], cut[2:4], cut[4], cut[5], cut[6]
        return out

    def gamma(self, discounts: np.ndarray) -> list[np.ndarray]:
        """What root and parents leave to what is above them."""
        return [(CONCENTRATION + discounts[k] * self.tables[k]) / (CONCENTRATION + self.customers[k]) for k in range(2)]


class Seating:
    """Customers and tables of a batch of words at each level: root, parents, leaves."""

    def __init__(self, size: np.ndarray, context: np.ndarray, n: np.ndarray):
        """``size``: contexts of each word; ``context`` and ``n``: of all words in a row, by context."""
        word = np.repeat(np.arange(len(size)), size)
        last = context // CLASSES
        head = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (last[1:] != last[:-1])]) if len(word) else np.zeros(0, np.int64)
        self.heads = [np.cumsum(size) - size, head]  # leaves of each word, leaves of each parent
        self.parents = np.bincount(word[head], minlength=len(size))
        self.first = np.cumsum(self.parents) - self.parents
        self.up = [np.zeros(len(size), np.int64), word[head], np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(word)]))]
        self.place = [np.zeros(len(size), np.int64), last[head], context]
        leaf = n.astype(np.float64)
        self._seat(leaf, lambda k, c: np.minimum(c, 1.0))

    def _seat(self, leaf: np.ndarray, draw) -> None:
        t2 = draw(2, leaf)
        c1 = np.add.reduceat(t2, self.heads[1]) if len(leaf) else leaf
        t1 = draw(1, c1)
        c0 = np.add.reduceat(t1, self.first) if len(c1) else np.zeros(0)
        self.customers, self.tables = [c0, c1, leaf], [draw(0, c0), t1, t2]

    def predictive(self, totals: Totals, d: np.ndarray, base: float, leaf: Contexts | None = None, levels: int = 3) -> list[np.ndarray]:
        """Probability of each word in each of its restaurants. ``leaf``: the contexts' totals, if not in ``totals``."""
        out, above, gamma = [], None, totals.gamma(d)
        for k in range(levels):
            at = self.place[k]
            if k < 2:
                seated, left = totals.customers[k][at], gamma[k][at]
            else:
                seated, own = (totals.leaf if leaf is None else leaf).at(at)
                left = (CONCENTRATION + d[k] * own) / (CONCENTRATION + seated)
            above = np.full(len(at), base) if above is None else above[self.up[k]]
            above = np.maximum(self.customers[k] - d[k] * self.tables[k], 0) / (CONCENTRATION + seated) + left * above
            out.append(above)
        return out

    def sweep(self, totals: Totals, d: np.ndarray, base: float, rng: np.random.Generator, leaf: Contexts | None = None) -> None:
        """Seat all customers again, given what was."""
        p = self.predictive(totals, d, base, leaf, 2)
        above = [np.full(len(self.place[0]), base), p[0][self.up[1]], p[1][self.up[2]]]
        others = [totals.tables[0][self.place[0]], totals.tables[1][self.place[1]], [*(totals.leaf if leaf is None else leaf).at(self.place[2])][1]]
        self._seat(self.customers[2], lambda k, c: tables(c, above[k], d[k], others[k], rng))


def word_contexts(training: DataFrame) -> DataFrame:
    """One row per word of the training texts: key, c, contexts (ascending), n (of each)."""
    spark = training.sparkSession
    common.small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in textops.sliced(batches):
            held.append(distinct(*tokens(batch.column(0))[:2]))
            if sum(len(x[0]) for x in held) > HELD:
                held = [distinct(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > HELD // 2:
                    yield from _pairs(held.pop())
        if held:
            yield from _pairs(distinct(*map(np.concatenate, zip(*held, strict=True))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last word, which may go on in the next batch
        words = lambda: _words(*map(np.concatenate, zip(*held, strict=True)))
        for batch in batches:
            if not batch.num_rows:
                continue
            k, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = k, pair >> COUNT, pair & ((1 << COUNT) - 1)
            if held and held[0][0][0] != k[0]:
                yield words()
                held = []
            whole = int(np.searchsorted(k, k[-1]))
            if whole:
                held.append(tuple(v[:whole] for v in x))
                yield words()
                held = []
            held.append(tuple(v[whole:] for v in x))
        if held:
            yield words()

    # pair: the context in the upper bits, its count in the lower ones
    pairs = training.select("text").mapInArrow(count, "key long, pair long")
    # a word comes once per task and context
    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(gather, "key long, c long, contexts array<int>, n array<long>")


def _pairs(x: tuple) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(x[0]), 100_000):
        k, c, n = (y[at: at + 100_000] for y in x)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64) << COUNT | n)], names=["key", "pair"])


def _words(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    n, k, c = np.add.reduceat(n, head), k[head], c[head]
    first, _ = textops.groups(k)
    off = pa.array(np.append(first, len(k)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.add.reduceat(n, first)), pa.ListArray.from_arrays(off, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(n))], names=["key", "c", "contexts", "n"])


class Model:
    """Totals of each sweep, the levels' discounts, and the counts of tokens and words. The contexts' totals are
    ``near`` (numbers, customers, tables of each sweep), or None if they are too many, and in ``frames``: tables with (cell,
    c, t) of the first seating, and with how many more t of each sweep."""

    def __init__(self, words: int, first: Totals):
        self.words, self.tokens, self.totals = words, int(first.tokens[0]), [first]
        # estimated from how many dishes have one and two customers
        self.d = np.where(first.ones > 0, np.clip(first.ones / np.maximum(first.ones + 2 * first.twos, 1), 0.1, 0.9), 0.5)
        self.base = 1 / (words + 1)
        self.near: tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None = None
        self.frames: list[DataFrame] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frames": []}

    def sweeps_kept(self) -> range:
        return range(min(1 + BURN_IN, len(self.totals) - 1), len(self.totals))

    def kept(self) -> list[Totals]:
        return [self.totals[i] for i in self.sweeps_kept()]

    def gamma(self) -> list[np.ndarray]:
        """Averaged over the kept sweeps."""
        return [np.mean(x, axis=0) for x in zip(*(t.gamma(self.d) for t in self.kept()), strict=True)]

    def unknown(self) -> float:
        """Log10 probability of the unknown word at the root."""
        return float(np.log10(self.gamma()[0][0] * self.base))

    def add_frame(self, frame: DataFrame) -> None:
        """The contexts' totals of one more sweep."""
        self.frames.append(frame)
        if len(self.frames) == 1:
            some = frame.filter("c > 1")
            if some.count() * 64 > LEAF_BYTES:
                return
            rows = some.toArrow()
            order = np.argsort(rows.column("cell").to_numpy())
            ids, c, t = (rows.column(x).to_numpy()[order] for x in ("cell", "c", "t"))
            self.near = ids.astype(np.int32), c, [t]
        elif self.near is not None:
            ids, _, tables_of = self.near
            rows = frame.toArrow()
            t = tables_of[0].copy()
            t[np.searchsorted(ids, rows.column("cell").to_numpy())] += rows.column("t").to_numpy()
            tables_of.append(t)

    def contexts(self) -> DataFrame:
        """ctx, c (customers), t (tables, of each sweep)."""
        out = self.frames[0].select(F.col("cell").alias("ctx"), "c", "t")
        for i, more in enumerate(self.frames[1:]):
            out = out.join(more.select(F.col("cell").alias("ctx"), F.col("t").alias(f"t{i}")), "ctx", "left")
        return out.select("ctx", "c", F.array("t", *[F.col("t") + F.coalesce(f"t{i}", F.lit(0.0)) for i in range(len(self.frames) - 1)]).alias("t"))

    def beside(self, words: DataFrame) -> DataFrame:
        """The words, with the totals of their contexts (number in the row, customers, tables) if these are not near."""
        if self.near is not None or not self.frames:
            return words.withColumn("own", F.lit(None).cast("array<struct<i:int,c:double,t:array<double>>>"))
        met = words.select("key", F.posexplode("contexts").alias("i", "ctx")).join(self.contexts().filter("c > 1"), "ctx")
        return words.join(met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "c", "t"))).alias("own")), "key", "left")

    def leaves(self, seats: Seating, own: pa.Array) -> list[Contexts]:
        """The totals of a seating's contexts in each sweep."""
        context = seats.place[2]
        if self.near is not None:
            ids, c, tables_of = self.near
            at, hit = found(ids, context.astype(np.int32))
            return [Beside(context, *(np.where(hit, x[at], 1.0) if len(x) else np.ones(len(context)) for x in (c, t))) for t in tables_of]
        off, rows = own.offsets.to_numpy(), own.flatten()
        at = np.repeat(seats.heads[0], np.diff(off)) + rows.field("i").to_numpy()
        c, t = np.ones(len(context)), np.ones((len(self.totals), len(context)))
        if len(at):
            c[at], t[:, at] = rows.field("c").to_numpy(), rows.field("t").flatten().to_numpy().reshape(len(at), -1).T
        return [Beside(context, c, x) for x in t]

    def replay(self, seed: int, seats: Seating, leaves: list[Contexts]) -> Iterator[Seating]:
        """The seating after each sweep that has totals in ``leaves``."""
        rng = np.random.default_rng(seed)
        yield seats
        for totals, leaf in zip(self.totals, leaves):
            seats.sweep(totals, self.d, self.base, rng, leaf)
            yield seats


def _seated(batch: pa.RecordBatch) -> tuple[Seating, int]:
    lists = batch.column(1)
    off = lists.offsets.to_numpy()
    key = batch.column(0).to_numpy().view(np.uint64)
    return Seating(np.diff(off), lists.flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()), int(np.bitwise_xor.reduce(textops.mix(key)))


def fit(words: DataFrame, sweeps: int = SWEEPS) -> Model:
    """Gibbs sweeps over a written table of words."""
    spark = words.sparkSession
    common.small_batches(spark)
    model, count = None, words.count()
    for _ in range(sweeps + 1):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, held, n = shared.value, Totals(), [], 0  # noqa: B023

            def rows(cell: np.ndarray, c: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
                for at in range(0, len(cell), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at: at + 100_000]) for x in (cell, c, t)], names=["cell", "c", "t"])

            for batch in batches:
                seats, seed = _seated(batch)
                if now is not None:
                    *_, seats = now.replay(seed, seats, now.leaves(seats, batch.column(3)))
                total.count(seats)
                # customers of contexts stay, tables are at least one a word: only what is more is sent again
                t = seats.tables[2] if now is None else seats.tables[2] - 1
                some = np.flatnonzero(t)
                held.append(_summed(seats.place[2][some], seats.customers[2][some], t[some]))
                n += len(held[-1][0])
                if n > HELD:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > HELD // 2:
                        yield from rows(*held.pop())
                        n = 0
            if held:
                yield from rows(*_summed(*map(np.concatenate, zip(*held, strict=True))))
            x = total.flat()
            used = np.flatnonzero(x)
            yield from rows(-1 - used, x[used], 0 * x[used])

        source = words if model is None else model.beside(words)
        source = source.select("key", "contexts", "n", *(["own"] if model is not None else []))
        got = common.written(source.mapInArrow(run, "cell long, c double, t double").groupBy("cell").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "totals")
        dense = got.filter("cell < 0").toArrow()
        x = np.zeros(len(Totals().flat()))
        x[-1 - dense.column("cell").to_numpy()] = dense.column("c").to_numpy()
        if model is None:
            model = Model(count, Totals.of(x))
        else:
            model.totals.append(Totals.of(x))
        model.add_frame(got.filter("cell >= 0"))
    return model


def pair_keys(keys: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A 64-bit key of a word in a context."""
    return textops.mix(keys ^ textops.mix(context.astype(np.uint64) + END_KEY)).view(np.int64)


def predictive(words: DataFrame, model: Model) -> DataFrame:
    """key, c, root, parents, parent_lp, pairs, leaf_lp, n: log10 of each word's averaged probability at the
    root, in its parents and in its contexts, the latter under the pairs' keys with their counts."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept = m.sweeps_kept()
        for batch in batches:
            seats, seed = _seated(batch)
            leaves = m.leaves(seats, batch.column(4))
            sums = [np.zeros(len(x)) for x in seats.place]
            for i, after in enumerate(m.replay(seed, seats, leaves[:-1])):
                if i >= kept[0]:
                    for total, p in zip(sums, after.predictive(m.totals[i], m.d, m.base, leaves[i]), strict=True):
                        total += p
            logs = [np.log10(x / len(kept)) for x in sums]
            off = pa.array(np.append(seats.first, len(logs[1])).astype(np.int32))
            cells = batch.column(1).offsets.to_numpy()
            cells = pa.array((cells - cells[0]).astype(np.int32))
            keys = np.repeat(batch.column(0).to_numpy().view(np.uint64), np.diff(cells))
            lists = lambda o, x: pa.ListArray.from_arrays(o, pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(logs[0]), lists(off, seats.place[1].astype(np.int32)), lists(off, logs[1].astype(np.float32)),
                                              lists(cells, pair_keys(keys, seats.place[2])), lists(cells, logs[2].astype(np.float32)), lists(cells, seats.customers[2].astype(np.int64))],
                                             names=["key", "c", "root", "parents", "parent_lp", "pairs", "leaf_lp", "n"])

    return model.beside(words).select("key", "contexts", "n", "c", "own").mapInArrow(run, "key long, c long, root double, parents array<int>, parent_lp array<float>, pairs array<long>, leaf_lp array<float>, n array<long>")


def _frequent(known: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (ascending), counts and log10 probabilities [word, parent] of the words
    with a FREQUENT-th of all tokens or more, at most FREQUENT of them."""
    rows = known.filter(F.col("c") * FREQUENT >= model.tokens).select("key", "c", "root", "parents", "parent_lp").toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    left = np.log10(model.gamma()[1])
    out = np.zeros((len(keys), PARENTS), np.float32)
    root = rows.column("root").to_numpy()
    lists = {x: (col.offsets.to_numpy(), col.values.to_numpy()) for x in ("parents", "parent_lp") for col in [rows.column(x).combine_chunks()]}
    for i, at in enumerate(order.tolist()):
        (off, parents), (_, lp) = lists["parents"], lists["parent_lp"]
        out[i] = left + root[at]
        out[i, parents[off[at]: off[at + 1]]] = lp[off[at]: off[at + 1]]
    return keys[order], rows.column("c").to_numpy()[order], out


def _sorted(rows: pa.Table, key: str, *columns: str) -> tuple[np.ndarray, ...]:
    order = np.argsort(rows.column(key).to_numpy())
    return tuple(rows.column(c).to_numpy()[order] for c in (key, *columns))


_TEXT = "doc_id long, held_out boolean, n_tokens long, known long, lp double, base double"
_ROWS = f"row long, pair long, n long, text struct<{_TEXT.replace(' ', ':').replace(',:', ', ')}>"
#: What held-out texts' rows have beyond that: the word, its context, and what is known of both where they are frequent.
_WORD = "key long, context long, often long, parent_lp double, left_lp double"


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity.

    Learns from rows where ``held_out`` is false and scores all. Null and empty
    texts are one end token. Without training rows every token is unknown at
    the uniform base. Repeated rows are scored each; other columns play no part.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    marked = common.documents_columns(docs).withColumn("held_out", held_out)
    words = common.written(word_contexts(marked.filter(~F.col("held_out"))), "words")
    model = fit(words)
    known = common.written(predictive(words, model), "predictive")
    floor = float(model.tokens + 0.1 * (model.words + 1))
    cells = known.select("c", F.explode(F.arrays_zip("pairs", "leaf_lp", "n")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("c").alias("seen"), F.col("x.leaf_lp").alias("leaf"), F.col("x.n").alias("times"))
    kept = [F.get("t", F.lit(i)) for i in model.sweeps_kept()]
    left = [(F.lit(CONCENTRATION) + F.lit(float(model.d[2])) * t) / (F.lit(CONCENTRATION) + F.col("c")) for t in kept]
    left = common.written(model.contexts().select("ctx", "c", F.log10(sum(left[1:], left[0]) / len(left)).alias("left")), "contexts")
    often = F.col("times") * FREQUENT_PAIRS >= model.tokens
    frequent = spark.sparkContext.broadcast((_sorted(cells.filter(often).toArrow(), "pair", "seen", "leaf"), _frequent(known, model),
                                             _sorted(left.filter(F.col("c") * FREQUENT >= model.tokens).toArrow(), "ctx", "left")))

    def rows_of(held: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 40
            (often, often_c, often_lp), (word, word_c, parent_lp), (ctx, ctx_lp) = frequent.value
            often_base = np.log10((often_c + 0.1) / floor)
            for batch in textops.sliced(batches):
                n_docs = batch.num_rows
                keys, context, off = tokens(batch.column("text"))
                pair = pair_keys(keys, context)
                rows = number + np.arange(n_docs)
                number += n_docs
                doc = np.repeat(np.arange(n_docs), np.diff(off))
                at, hit = found(often, pair)
                at, d = at[hit], doc[hit]
                sums = [np.bincount(d, x[at], n_docs).astype(float) for x in (often_lp, often_base)]  # of nothing numpy counts whole numbers
                # a text's own row has the sums of its frequent pairs, under a key that is no pair's
                own = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(off)), pa.array(np.bincount(d, minlength=n_docs)), pa.array(sums[0]), pa.array(sums[1])], names=[x.split()[0] for x in _TEXT.split(", ")])
                first = [pa.array(rows), pa.array(textops.mix(rows.astype(np.uint64)).view(np.int64)), pa.nulls(n_docs, pa.int64()), own]
                doc, pair, keys, context = (x[~hit] for x in (doc, pair, keys, context))
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
                rest = [pa.array(rows[doc[head]]), pa.array(pair[head]), pa.array(np.diff(np.r_[head, len(doc)])), pa.nulls(len(head), own.type)]
                names = ["row", "pair", "n", "text"]
                if held:
                    key, at = keys[order][head], context[order][head]
                    (w, is_word), (x, is_ctx) = found(word, key), found(ctx, at)
                    value = lambda v, i, on: pa.array(v[i] if len(v) else np.zeros(len(on)), mask=~on)
                    names += [c.split()[0] for c in _WORD.split(", ")]
                    first += [pa.nulls(n_docs, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    lp = parent_lp[w, at // CLASSES].astype(float) if len(word) else np.zeros(len(at))
                    rest += [pa.array(key.view(np.int64)), pa.array(at), value(word_c, w, is_word).cast(pa.int64()), pa.array(lp, mask=~is_word), value(ctx_lp, x, is_ctx).cast(pa.float64())]
                yield pa.RecordBatch.from_arrays(first, names=names)
                yield pa.RecordBatch.from_arrays(rest, names=names)

        return run

    table = cells.filter(~often).drop("times").hint("merge")
    text = F.col("text").isNotNull()

    def summed(joined: DataFrame, seen: F.Column, lp: F.Column) -> DataFrame:
        seen = F.coalesce(seen, F.lit(0))
        return joined.groupBy("row").agg(
            *[F.max(f"text.{x}").alias(x) for x in ("doc_id", "held_out", "n_tokens")],
            F.sum(F.when(text, F.col("text.known")).when(seen > 0, F.col("n")).otherwise(0)).cast("long").alias("n_known"),
            F.sum(F.when(text, F.col("text.base")).otherwise(F.col("n") * F.log10((seen + F.lit(0.1)) / F.lit(floor)))).alias("base_score"),
            F.sum(F.when(text, F.col("text.lp")).otherwise(F.col("n") * lp)).alias("score"))

    # training texts have no pair that is not in the table
    trained = summed(marked.filter(~F.col("held_out")).mapInArrow(rows_of(False), _ROWS).join(table, "pair", "left"), F.col("seen"), F.col("leaf"))
    others = marked.filter(F.coalesce("held_out", F.lit(True))).mapInArrow(rows_of(True), f"{_ROWS}, {_WORD}").join(table, "pair", "left")
    # rows that need nothing more go on under keys that are no word's or context's
    new, any_key = F.col("leaf").isNull() & ~text, F.xxhash64("row", "pair")
    others = others.withColumns({"_key": F.when(new & F.col("often").isNull(), F.col("key")).otherwise(any_key), "_ctx": F.when(new & F.col("left_lp").isNull(), F.col("context")).otherwise(-1 - F.abs(F.shiftright(any_key, 1)))})
    others = others.join(known.select(F.col("key").alias("_key"), F.col("c").alias("word_c"), "root", "parents", F.col("parent_lp").alias("lps")), "_key", "left")
    others = others.join(left.select(F.col("ctx").alias("_ctx"), "left"), "_ctx", "left")
    parent = F.shiftright("context", 20).cast("int")
    in_parent = F.array_position("parents", parent)
    above = F.when(in_parent > 0, F.get("lps", (in_parent - 1).cast("int")).cast("double")).otherwise(
        F.get(F.array(*[F.lit(float(x)) for x in np.log10(model.gamma()[1])]), parent) + F.coalesce("root", F.lit(model.unknown())))
    held = summed(others, F.when(new, F.coalesce("often", "word_c")).otherwise(F.col("seen")),
                  F.when(new, F.coalesce("left_lp", "left", F.lit(0.0)) + F.coalesce(F.col("parent_lp"), above)).otherwise(F.col("leaf")))
    return trained.unionByName(held).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def annotate(docs: DataFrame) -> DataFrame:
    """Held out are rows with remainder(10) = 0; see ``score``."""
    return score(docs, remainder(10) == 0)
