"""Source divergence audit: how the words of each source differ from those of its language.

Two passes over the texts. The first counts exactly in how many documents of a
language each term occurs and keeps those above a threshold. The kept terms of
a language are dealt over shards, and each shard becomes a minimal perfect hash
that stores its keys. The shards are broadcast in waves of bounded bytes; the
second pass finds each term's slot, verifies it against the stored key and
increments a dense array of slots for each (language, source) group. The arrays
are summed by one shuffle, and the divergences are computed per language in
blocks of terms, in exact integers.

Null texts, languages and sources are ''. Every row is a document, repeated
ones too. A group without terms takes part with counts of zero; in a language
without kept terms all pairs have value 0. Other columns play no part; an empty
table gives an empty result. Counts are exact below 9 * 10^15 tokens a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textops
from .perfect_hash import PerfectHash, same_bytes

#: Kept terms a shard holds on average, and bytes of shards broadcast at a time.
SHARD_TERMS, WAVE_BYTES = 1 << 16, 48 << 20
#: Slots of a task's dense arrays (four bytes each); beyond, they are given out and begun anew.
DENSE_SLOTS, DENSE_TOKENS = 1 << 24, 1 << 30
#: Counts (language, source, term) of a block of terms, and cells of its matrix computed at a time.
BLOCK_COUNTS, CELLS = 100_000, 1 << 20
SCALE = 1_000_000_000

#: Bytes that part terms: all but A-Z, a-z and those of non-ASCII characters.
PARTS = np.zeros(256, bool)
PARTS[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the terms' starts, ends and keys, and their documents."""
    buf, off = textops.flat(batch.column("text"))
    buf = textops.lower_ascii(buf)
    start, end, bounds = textops.spans(buf, off, PARTS)
    return buf, start, end, textops.word_keys(buf, start, end), np.repeat(np.arange(batch.num_rows), np.diff(bounds))


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = pc.dictionary_encode(column)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of documents: lang, term, in how many documents."""
    for batch in textops.sliced(batches):
        buf, start, end, keys, doc = _words(batch)
        if not len(keys):
            continue
        lang, names = _codes(batch.column("lang"))
        own = textops.mix(keys + textops.mix(np.arange(1, len(names) + 1, dtype=np.uint64))[lang[doc]])
        order = np.argsort(own, kind="stable")  # a key's documents stay in order
        own, doc, start, end = own[order], doc[order], start[order], end[order]
        head, size = textops.groups(own)
        first = np.repeat(head, size)
        length = end - start
        if not ((length == length[first]).all() and (lang[doc] == lang[doc[first]]).all() and same_bytes(buf, start, buf, start[first], length).all()):
            yield from _plainly(buf, start, end, doc, lang, names)  # two terms of one 64-bit key
            continue
        new = np.ones(len(own), np.int64)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[doc[head]])), textops.strings(buf, start[head], end[head]), pa.array(np.add.reduceat(new, head))], names=["lang", "term", "n"])


def _plainly(buf, start, end, doc, lang, names) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[int, bytes], set[int]] = {}
    for a, b, d in zip(start.tolist(), end.tolist(), doc.tolist(), strict=True):
        seen.setdefault((int(lang[d]), buf[a:b].tobytes()), set()).add(d)
    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k, _ in seen], pa.string()), pa.array([t.decode() for _, t in seen], pa.string()), pa.array([len(x) for x in seen.values()], pa.int64())], names=["lang", "term", "n"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = textops.flat(batch.column("term"))
        yield batch.append_column("key", pa.array(textops.word_keys(buf, off[:-1], off[1:]).view(np.int64)))


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    buf, off = textops.flat(rows.column("term"))
    made = PerfectHash.build(buf, off[:-1], off[1:]).to_bytes()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int64()), "shards": rows.column("shards").slice(0, 1), "bytes": pa.array([len(made)], pa.int64()), "payload": pa.array([made], pa.binary())})


def vocabulary(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, term: the terms of at least ``least`` documents of their language."""
    found = docs.mapInArrow(_frequencies, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def shards(terms: DataFrame, per_shard: int = SHARD_TERMS) -> DataFrame:
    """lang, shard, shards (of the language), bytes, payload: a perfect hash per shard of the written ``terms``."""
    many = terms.groupBy("lang").agg(F.ceil(F.count("*") / per_shard).alias("shards"))
    keyed = terms.mapInArrow(_keyed, "lang string, term string, key long").join(common.if_small(many), "lang")
    dealt = keyed.select("lang", "term", "shards", F.pmod("key", "shards").alias("shard"))
    return dealt.groupBy("lang", "shard").applyInArrow(_shard, "lang string, shard long, shards long, bytes long, payload binary")


def _waves(sizes: list, most: int) -> Iterator[list]:
    """Consecutive shards of at most so many bytes together; a larger one comes alone."""
    wave, held = [], 0
    for row in sizes:
        if wave and held + row["bytes"] > most:
            yield wave
            wave, held = [], 0
        wave.append(row)
        held += row["bytes"]
    if wave:
        yield wave


def _recount(held, dense_slots: int):
    """Counts of the terms of the broadcast shards in each group: lang, source, term, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[str, int] = {}
        hashes: dict[str, list[tuple[int, PerfectHash]]] = {}
        for lang, shard, of, payload in held.value:
            many[lang] = of
            hashes.setdefault(lang, []).append((shard, PerfectHash.from_bytes(payload)))
        counts: dict[tuple[str, int, str], np.ndarray] = {}
        slots = tokens = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, k, source), n in counts.items():
                shard, at = hashes[lang][k][1], np.flatnonzero(n)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), textops.strings(shard.data, shard.starts[at], shard.ends[at]), pa.array(n[at].astype(np.int64))], names=["lang", "source", "term", "n"])

        for batch in textops.sliced(batches):
            batch = batch.filter(pc.is_in(batch.column("lang"), value_set=pa.array(list(hashes), pa.string())))
            if not batch.num_rows:
                continue
            buf, start, end, keys, doc = _words(batch)
            lang, langs = _codes(batch.column("lang"))
            source, sources = _codes(batch.column("source"))
            tokens += len(keys)
            for i, name in enumerate(langs):
                mine = np.flatnonzero(lang[doc] == i)
                part = np.mod(keys[mine].view(np.int64), many[name])
                for k, (number, shard) in enumerate(hashes[name]):
                    at = mine[part == number]
                    slot = shard.find(buf, start[at], end[at], keys[at])
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    group = source[doc[at]]
                    order = np.argsort(group, kind="stable")
                    group, slot = group[order], slot[order]
                    for a, n in zip(*textops.groups(group), strict=True):
                        g = (name, k, sources[int(group[a])])
                        if g not in counts:
                            if counts and slots + shard.n > dense_slots:
                                yield from given()
                                counts, slots = {}, 0
                            counts[g] = np.zeros(shard.n, np.int32)
                            slots += shard.n
                        np.add.at(counts[g], slot[a: a + n], 1)
            if tokens > DENSE_TOKENS:
                yield from given()
                counts, slots, tokens = {}, 0, 0
        yield from given()

    return run


def recounted(docs: DataFrame, hashes: DataFrame, wave_bytes: int = WAVE_BYTES, dense_slots: int = DENSE_SLOTS) -> DataFrame:
    """lang, source, term, n (over 0): how often each term of the written shards occurs in each group."""
    spark, out = docs.sparkSession, None
    sizes = hashes.select("lang", "shard", "bytes").orderBy("lang", "shard").collect()  # a row for 65,536 terms
    for wave in _waves(sizes, wave_bytes):
        low, high = [F.struct(F.lit(x["lang"]).alias("lang"), F.lit(x["shard"]).alias("shard")) for x in (wave[0], wave[-1])]
        here = hashes.filter(F.struct("lang", "shard").between(low, high)).select("lang", "shard", "shards", "payload")
        held = spark.sparkContext.broadcast([(r[0], r[1], r[2], bytes(r[3])) for r in here.toLocalIterator()])
        found = docs.mapInArrow(_recount(held, dense_slots), "lang string, source string, term string, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 < count <= total < 9e15, exactly: long division by three digits at a time."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def _block(top: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sources, total = right.column("source").to_pylist(), right.column("n").to_numpy().astype(np.int64)
        order = {s: i for i, s in enumerate(sources)}
        term, terms = _codes(left.column("term").combine_chunks())
        coded, names = _codes(left.column("source").combine_chunks())
        source = np.array([order[s] for s in names], np.int64)[coded] if names else coded
        n = left.column("n").to_numpy()
        kept = int(right.column("terms")[0].as_py()) if len(right) else 0
        whole = int(right.column("lang_n")[0].as_py()) + kept if len(right) else 1
        by_term = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
        pairs = np.zeros((len(sources), len(sources)), np.int64)
        best = []
        step = max(1, CELLS // max(1, len(sources)))
        for at in range(0, len(terms), step):
            rows = by_term[bounds[at]: bounds[min(at + step, len(terms))]]
            c = np.zeros((min(step, len(terms) - at), len(sources)), np.int64)
            c[term[rows] - at, source[rows]] = n[rows]
            p = probability(c + 1, total + kept)
            for g in range(len(sources)):
                pairs[g] += ((p[:, g: g + 1] - p) ** 2 // p).sum(axis=0)
            q = probability(c.sum(axis=1) + 1, np.int64(whole))
            r, s = np.nonzero((c > 0) & (p > q[:, None]))
            best.append(pa.table({"source": pa.array(s), "item": pa.array(terms, pa.string()).take(pa.array(r + at)), "value": pa.array((p[r, s] - q[r]) ** 2 // q[r])}))
        g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
        name = pa.array(sources, pa.string())
        out = [pa.table({"source": name.take(pa.array(g)), "part": pa.array(["pair"] * len(g), pa.string()), "item": name.take(pa.array(h)), "value": pa.array(pairs[g, h], pa.int64())})]
        if best:
            found = pa.concat_tables(best).sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
            group = found.column("source").to_numpy()
            head, size = textops.groups(group)
            near = found.filter(pa.array(np.arange(len(group)) - np.repeat(head, size) < top))
            out.append(pa.table({"source": name.take(near.column("source").combine_chunks()), "part": pa.array(["term"] * len(near), pa.string()), "item": near.column("item"), "value": near.column("value")}))
        made = pa.concat_tables(out)
        return made.add_column(0, "lang", pa.array([lang] * len(made), pa.string()))

    return run


def audit(docs: DataFrame, least: int = 3, top: int = 200, per_shard: int = SHARD_TERMS, wave_bytes: int = WAVE_BYTES, dense_slots: int = DENSE_SLOTS, block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of ``docs``.

    ``part`` is ``pair`` (item: another source of the language; value: the
    summed divergence from it) or ``term`` (item: a term that is more frequent
    in the group than in its language, the ``top`` of them by value).
    """
    common.small_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("text"), blank("lang"), blank("source"))
    terms = common.written(vocabulary(docs, least), "terms")
    hashes = common.written(shards(terms, per_shard), "perfect-hashes")
    counts = common.written(recounted(docs, hashes, wave_bytes, dense_slots), "recounts")

    groups = docs.select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(counts.select("lang", "source", "n"))
    groups = groups.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.ceil(F.count("*") / block_counts).alias("least_blocks"))
    langs = langs.join(sums, "lang", "left").na.fill(0)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    langs = common.written(langs.withColumn("blocks", F.greatest(F.col("least_blocks"), F.lit(min(parts, 64)).cast("long"))), "languages")
    groups = common.written(groups.join(common.if_small(langs), "lang", "left"), "groups")

    dealt = counts.join(common.if_small(langs.select("lang", "blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    each = groups.filter("blocks IS NOT NULL").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "block", "source", "n", "terms", "lang_n")
    values = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(_block(top), "lang string, source string, part string, item string, value long")
    bare = groups.filter("blocks IS NULL").select("lang", "source")  # languages without kept terms
    other = bare.select("lang", F.col("source").alias("item"))
    zero = bare.join(other, "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    whole = values.unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return whole.withColumn("rank", F.row_number().over(best)).filter((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
         w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
         kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
         c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
         g AS (SELECT DISTINCT lang, source FROM d),
         gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
         ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
         v AS (SELECT lang, count(*) AS many FROM kept GROUP BY lang),
         p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.many)::HUGEINT) AS p
               FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
         q AS (SELECT x.lang, x.term, (1 + (1000000000::HUGEINT * (x.n + 1)) // (ln.total + v.many)::HUGEINT) AS q
               FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) x JOIN ln USING (lang) JOIN v USING (lang)),
         pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
         pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
         f AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN pv USING (lang, source, item)
               UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
         r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
