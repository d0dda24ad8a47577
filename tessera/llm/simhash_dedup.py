"""SimHash near-duplicates through covering locality-sensitive hashing.

Each document has a 64-bit fingerprint of its word shingles. Every bit place
is given a vector of ``radius + 1`` bits; a table is made for each non-zero
vector v of that length, and its mask keeps the places whose vector is
orthogonal to v. Two fingerprints that differ in at most ``radius`` places
differ at vectors that cannot span the whole space, so some v is orthogonal to
all of them: in that table both have the same key. No pair within the radius
is missed.

Documents with one fingerprint are one node. A bucket of at most ``BUCKET``
nodes is compared pair by pair. A larger one is split exactly: its places
outside the mask are cut into radius + 1 blocks of which a close pair shares
one; what is still too large goes by neighbours, where each node is filed
under every value one flip away, so that a file holds at most 65 nodes, all
within two flips of each other. Connected groups come from alternating
large-star and small-star steps over shuffled edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textops

#: Nodes of a bucket that are compared pair by pair.
BUCKET = 256


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of one text (UTF-8): A to Z lowered, words parted by white space."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(parts) - k + 1
    for at in range(0, n, 8192):
        to = min(n, at + 8192)
        h = [digest(view[a:b], 42) for a, b in zip((end - size)[at:to].tolist(), end[at + k - 1: to + k - 1].tolist(), strict=True)]
        votes += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.sliced(batches):
            found = [fingerprint(t.encode(), words) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    common.small_batches(docs.sparkSession)
    return common.documents_columns(docs).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks, 2 ** (radius + 1) - 1 of them, as signed longs."""
    size = radius + 1
    vector = [i % (2**size - 1) + 1 for i in range(64)]  # each non-zero vector equally often
    of = lambda v: sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2 == 0)
    return [m - 2**64 if m >= 2**63 else m for m in map(of, range(1, 2**size))]


def _signed(mask: int) -> int:
    mask &= 2**64 - 1
    return mask - 2**64 if mask >= 2**63 else mask


def _blocks(mask: int, radius: int) -> list[int]:
    """The places outside a mask in radius + 1 blocks: close nodes of its bucket agree on one."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in free[b:: radius + 1])) for b in range(radius + 1)]


def _sized(keyed: DataFrame) -> DataFrame:
    """Adds n, the nodes of each bucket. Partial counts come first; the join back has no hot side beyond them."""
    keys = [c for c in keyed.columns if c != "fp"]
    return keyed.join(keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), keys)


def _pairs(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    a, b = keyed.select(*keys, F.col("fp").alias("a")), keyed.select(*keys, F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.join(b.hint("shuffle_hash"), keys).filter(near).select("a", "b")


def links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that differ in at
    most ``radius`` places: every such pair, or a star that joins the same nodes."""
    if not 1 <= radius <= 2:
        raise ValueError("the split of large buckets is exact for a radius of 1 or 2")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = common.written(_sized(nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")), "buckets")
    edges = _pairs(keyed.filter(F.col("n") <= bucket), ["t", "key"], radius)
    large = keyed.filter(F.col("n") > bucket)
    if large.limit(1).count():
        cut = F.lit(None)
        for t, m in enumerate(masks(radius)):
            parts = F.array(*[F.struct(F.lit(b).alias("block"), F.col("fp").bitwiseAND(F.lit(m | p)).alias("part")) for b, p in enumerate(_blocks(m, radius))])
            cut = F.when(F.col("t") == t, parts) if t == 0 else cut.when(F.col("t") == t, parts)
        split = common.written(_sized(large.select("fp", "t", F.explode(cut).alias("x")).select("fp", "t", "x.block", "x.part")), "split")
        edges = edges.unionByName(_pairs(split.filter(F.col("n") <= bucket), ["t", "block", "part"], radius))
        crowded = common.written(split.filter(F.col("n") > bucket).select("fp").distinct(), "crowded")
        if crowded.limit(1).count():
            flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
            filed = crowded.select("fp", F.explode(flips).alias("file"))
            star = F.collect_set("fp").alias("members")  # at most 65: all one flip from the file's value
            near = filed.groupBy("file").agg(star).filter(F.size("members") > 1)
            if radius == 1:
                near = near.filter(F.array_contains("members", F.col("file"))).select(F.col("file").alias("root"), "members")
            else:
                near = near.select(F.array_min("members").alias("root"), "members")
            edges = edges.unionByName(near.select(F.col("root").alias("a"), F.explode("members").alias("b")).filter("a <> b"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for every node that has an edge.

    Alternates large-star and small-star steps until the edges stay the same;
    they then link each node to its component's smallest.
    """
    def step(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least, "u")
        if large:
            out = out.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = out.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before = common.written(edges, "edges"), None
    state = mark(now)
    while state != before:
        before = state
        now = common.written(step(common.written(step(now, True), "large-star"), False), "small-star")
        state = mark(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def annotate(docs: DataFrame, words: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links, null
    only if no member has a doc_id. Null and empty texts have fingerprint zero
    and link like any other. Repeated rows share a fingerprint and so a
    component. Other columns play no part; an empty table gives an empty result.
    """
    prints = common.written(fingerprints(docs, words), "fingerprints")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = common.written(components(links(classes.select("fp"), radius, bucket)), "components")
    rooted = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a class of many copies has many rows of one key on the documents' side only: AQE splits it
    answer = rooted.join(linked, "root").select("fp", "component_id")
    return prints.join(answer, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component, the smallest doc_id. Rows
    without a doc_id stay; rows repeating a kept doc_id are that document."""
    dropped = annotate(docs, words, radius).filter("doc_id <> component_id").select("doc_id").distinct()
    return common.without_ids(docs, common.written(dropped, "dropped"))
