"""License scan: notices as token sets, found by an exact set-similarity join.

A template is held where some span of words, twice as long as the template and
wherever lines break, has at least a share ``CONTAINMENT`` of its distinct words.
Text blocks are overlapping windows in one of which each such span lies whole.
Template words are ordered by how many blocks of the whole corpus have them, rare ones first: a block
that reaches the share must have one of a template's first words (prefix
filter), enough words of templates at all (length filter), and enough left at
or after its place of the shared word (positional filter); what passes is
counted exactly, in windows span by span. Beside it, phrases are found word by word. Everything is
DataFrame functions, and each template is weighed against each block by this
join alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CONTAINMENT = 0.9
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of well-known licenses, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _PARTS), lambda w: w != "")


def _template_sets() -> list[tuple[int, str, list[str]]]:
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        flat = "".join(c if c.isalnum() else " " for c in text.lower())
        out.append((i, label, sorted(set(flat.split()))))
    return out


def _span(template: int) -> int:
    return 2 * len(TEMPLATES[template][1].split())


#: Words from one window to the next; a window has twice as many.
_STEP = max(map(_span, range(len(TEMPLATES))))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _window(w: Column, block: Column) -> Column:
    return F.slice(w, block * _STEP + 1, 2 * _STEP)


def _low(text: str = "text") -> Column:
    """The text in lower case, null as empty. Words are held against ASCII words alone, and
    of all other characters only the Kelvin sign has an ASCII letter as its lower case:
    it becomes some other letter, so that A to Z alone are lowered as far as it counts."""
    return F.lower(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0142")))


def _scan(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row: row, doc_id, key (a hash of the text), n_words, places of phrases, and each block's distinct template words."""
    low = docs.select("doc_id", _low().alias("low"))
    # only texts in which a phrase may stand are taken apart for places
    maybe = F.col("low").rlike("|".join(_PARTS.join(p.split()) for p in PHRASES))

    def starts(phrase: str, w: Column) -> Column:
        parts = phrase.split()
        here = lambda i: F.slice(w, i + 1, len(parts)) == _strings(parts)
        return F.when(F.size(w) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), here)).otherwise(F.array().cast("array<int>"))

    phrases = F.when(maybe, common.let(_tokens(F.col("low")), lambda w: F.struct(*[starts(p, w).alias(label) for p, label in PHRASES.items()])))
    vocab = _strings(vocabulary)
    # no block is left out, their places count
    blocks = common.let(_tokens(F.col("low")), lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / _STEP).cast("int")), lambda c: F.array_intersect(_window(w, c), vocab)))
    n_words = F.regexp_count("low", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    return low.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("low").alias("key"), n_words.alias("n_words"), phrases.alias("phrases"), blocks.alias("blocks"))


def _in_spans(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` where one span of a template's length has the words needed; n is the most that one has."""
    held = common.written(held, "held")
    wanted = common.written(held.groupBy("key").agg(F.collect_set(F.struct("block", "template", "tokens", "span")).alias("spots")), "spots")
    low = docs.select(_low().alias("low"))
    texts = low.withColumn("key", F.xxhash64("low")).join(common.if_small(wanted), "key").dropDuplicates(["key"])
    windows = texts.select("key", "spots", _tokens(F.col("low")).alias("w")).select("key", "w", F.explode("spots").alias("s")).select("key", "s.*", _window(F.col("w"), F.col("s.block")).alias("w"))
    most = common.let(F.col("w"), lambda w: F.array_max(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.size(F.array_intersect(F.slice(w, i, F.col("span")), F.col("tokens"))))))
    spans = common.if_small(common.written(windows.select("key", "block", "template", most.alias("n")), "spans"))
    return held.drop("n").join(spans, ["key", "block", "template"]).filter("n >= needed")


def annotate(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    n_base counts the places of phrases, first_word and last_word are their
    smallest and largest start (null without any); labels joins the phrases'
    labels and those of templates that a span of twice their words contains,
    wherever lines break; score is 1 with a phrase, else the greatest
    containment that reaches the threshold, else 0.
    Null and empty texts have no words and no labels; repeated rows answer
    alike; other columns play no part.
    """
    spark = docs.sparkSession
    sets = _template_sets()
    vocabulary = sorted({t for _, _, s in sets for t in s})
    scanned = common.written(_scan(docs, vocabulary), "scanned")

    # the global order of template words, by the blocks that have them; as many rows as there are such words
    counts = dict(scanned.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("token")).groupBy("token").count().collect())
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    prefix, whole = [], []
    for i, label, tokens in sets:
        ordered = sorted(tokens, key=rank.get)
        need = max(1, math.ceil(containment * len(ordered) - 1e-9))
        whole.append((i, label, ordered, need, _span(i)))
        prefix += [(t, i, place, len(ordered), need, rank[t]) for place, t in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(prefix, "token string, template int, place int, size int, need int, rank int"))
    templates = F.broadcast(spark.createDataFrame(whole, "template int, label string, tokens array<string>, needed int, span int"))
    ordered_vocabulary = _strings(sorted(vocabulary, key=rank.get))
    first = _strings(sorted({p[0] for p in prefix}))

    blocks = scanned.select("row", "key", F.posexplode("blocks").alias("block", "b")).filter(F.arrays_overlap("b", first))
    sorted_blocks = blocks.select("row", "key", "block", F.array_intersect(ordered_vocabulary, "b").alias("b"))  # in the global order
    shared = sorted_blocks.select("row", "key", "block", "b", F.explode(F.array_intersect("b", first)).alias("token")).join(prefixes, "token")
    left = F.size("b") - F.array_position("b", F.col("token")) + 1
    passed = shared.filter((F.size("b") >= F.col("need")) & (F.least(left, F.col("size") - F.col("place")) + F.least(F.array_position("b", F.col("token")) - 1, F.col("place")) >= F.col("need")))
    candidates = passed.select("row", "key", "block", "b", "template").distinct().join(templates, "template")
    held = candidates.withColumn("n", F.size(F.array_intersect("b", "tokens"))).filter("n >= needed")
    held = _in_spans(docs, held.drop("b"))
    by_row = held.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("n") / F.size("tokens")).alias("held"))

    names = list(PHRASES.values())
    places = F.flatten(F.array(*[F.coalesce(F.col(f"phrases.{x}"), F.array().cast("array<int>")) for x in names]))
    base = F.filter(F.array(*[F.when(F.size(F.coalesce(F.col(f"phrases.{x}"), F.array().cast("array<int>"))) > 0, F.lit(x)) for x in names]), lambda x: x.isNotNull())
    joined = scanned.select("row", "doc_id", "n_words", places.alias("places"), base.alias("base")).join(by_row, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return joined.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
                         F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                         F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"))


def oracle(containment: float = CONTAINMENT) -> str:
    """The same answer in DuckDB SQL: the words of each template that stand in the span from each of its words on."""
    rows = ", ".join(f"({i}, '{label}', [{', '.join(repr(t) for t in tokens)}], {_span(i)})" for i, label, tokens in _template_sets())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    place = " UNION ALL ".join(f"SELECT row, '{label}' AS label, i - 1 AS p FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(template, label, tokens, span)),
tw AS (SELECT template, span, unnest(tokens) AS token FROM t),
dw AS (SELECT row, i AS p, w[i] AS token FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
hit AS (SELECT row, template, span, p, token FROM dw JOIN tw USING (token)),
many AS (SELECT row, template FROM hit JOIN t USING (template) GROUP BY row, template HAVING count(DISTINCT token) >= any_value(ceil({containment} * len(tokens) - 1e-9))),
near AS (SELECT hit.* FROM hit JOIN many USING (row, template)),
n AS (SELECT a.row, a.template, a.p, count(DISTINCT b.token) AS n FROM near a JOIN near b ON a.row = b.row AND a.template = b.template AND b.p >= a.p AND b.p < a.p + a.span GROUP BY ALL),
h AS (SELECT row, label, max(n) / any_value(len(tokens)) AS c FROM n JOIN t USING (template) WHERE n >= ceil({containment} * len(tokens) - 1e-9) GROUP BY row, template, label),
p AS ({place}),
base AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM p GROUP BY row),
labels AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM h UNION SELECT row, label FROM p) GROUP BY row),
base_labels AS (SELECT row, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT row, label FROM p) GROUP BY row),
held AS (SELECT row, max(c) AS c FROM h GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN labels USING (row) LEFT JOIN base_labels USING (row) LEFT JOIN held USING (row)"""
