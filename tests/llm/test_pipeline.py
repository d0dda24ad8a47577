import importlib
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import common, packing, quality, simhash_dedup
from test_decontaminate_licenses import brute
from test_dedup import components, norm, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    scored = quality.annotate(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    docs = [x for x in docs if x[0] in good]
    first = {}
    for d, t in sorted(docs):
        first.setdefault(norm(t), d)
    docs = [x for x in docs if x[0] in set(first.values())]
    roots = components([plain_fingerprint(t) for _, t in docs], 2)
    least = {}
    for (d, _), r in zip(docs, roots):
        least[r] = min(d, least.get(r, d))
    docs = [x for x in docs if x[0] in set(least.values())]
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaked = {d for d, _ in brute([(d, t) for d, t in docs if any(len(set(shingles(t)) & set(shingles(q))) for _, q in items)], items)}
    left = {d for d, _ in docs} - leaked
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == left
    assert leaked and 0 < len(left) < 200
    want = packing.pack(common.table(spark, SF, "documents").filter(common.F.col("doc_id").isin(left)))
    pieces = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert pieces(got) == pieces(want)


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    return [tuple(w[i: i + 5]) for i in range(len(w) - 4)]


def test_stages_keep_columns(spark):
    docs = common.table(spark, SF, "documents").withColumn("extra", common.F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_an_empty_table(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    names = entry.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and names["pipeline"] is corpus_pipeline.run
    assert {"op1_decontamination", "op2_exact_dedup", "op3_license_scan"} <= set(entry.oracle_sql())


def test_missing_folder_is_the_only_thing_the_entry_forgives(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "tessera.llm" else found(name, *a))
    assert not any(x.startswith("op1_") for x in entry.queries()) and "pipeline" not in entry.queries()


def test_wrong_radius():
    with pytest.raises(ValueError):
        simhash_dedup.links(None, radius=3)
