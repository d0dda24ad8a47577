"""Source divergence audit, hard-negative mining and the WARC source, against brute force."""

import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, hard_negatives, textops, warc
from tessera.llm.perfect_hash import PerfectHash

# ---- perfect hash ------------------------------------------------------------------------


def spans_of(words):
    buf, off = textops.flat(pa.array(words))
    return buf, off[:-1], off[1:]


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_refuses_strangers(n):
    words = [f"wörd{i}" for i in range(n)]
    buf, start, end = spans_of(words)
    h = PerfectHash.from_bytes(PerfectHash.build(buf, start, end).to_bytes())
    slot = h.find(buf, start, end, textops.word_keys(buf, start, end))
    assert sorted(slot.tolist()) == list(range(n)) and [h.key(s).decode() for s in slot.tolist()] == words
    buf, start, end = spans_of([f"wörd{i}x" for i in range(n)])
    assert (h.find(buf, start, end, textops.word_keys(buf, start, end)) == -1).all()


def test_perfect_hash_verifies_bytes_and_keeps_colliding_keys(monkeypatch):
    monkeypatch.setattr(textops, "word_keys", lambda buf, start, end: np.array([len(buf[a:b]) for a, b in zip(start, end)], np.uint64))
    buf, start, end = spans_of(["aa", "bb", "c", "dddd"])  # "aa" and "bb" have one key
    h = PerfectHash.from_bytes(PerfectHash.build(buf, start, end).to_bytes())
    slot = h.find(buf, start, end, textops.word_keys(buf, start, end))
    assert sorted(slot.tolist()) == [0, 1, 2, 3] and len(h.crowd) == 2
    buf, start, end = spans_of(["ab", "d", "eeee", "zzzzz"])
    assert (h.find(buf, start, end, textops.word_keys(buf, start, end)) == -1).all()


# ---- op11 --------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, term string, n int, `block` int, shard int"


def brute_audit(rows, least=3, top=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)), la or "", s or "") for _, t, la, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        df = {}
        for words, la, _ in docs:
            for w in set(words) if la == lang else ():
                df[w] = df.get(w, 0) + 1
        kept = {w for w, n in df.items() if n >= least}
        counts = {}
        for words, la, s in docs:
            if la == lang:
                c = counts.setdefault(s, dict.fromkeys(kept, 0))
                for w in words:
                    if w in kept:
                        c[w] += 1
        total = {w: sum(c[w] for c in counts.values()) for w in kept}

        def prob(c):
            n = sum(c.values()) + len(kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // n for w in kept}
        q, p = prob(total), {s: prob(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, v, i + 1))
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)
    got = divergence.audit(df.repartition(3), **options)
    assert dict(got.dtypes)["value"] == "bigint"
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def audit_rows(n=120, seed=5):
    rnd = random.Random(seed)
    words = ["Alpha", "ALPHA", "beta", "été", "ß", "x_y", "don't", "日本", "a1b", "Z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["s1", "s2", "s3", None, "日"])) for i in range(n)]
    rows += [(1000, None, "en", "bare"), (1001, "", "only", "one"), (1002, "123 ...", "only", "two"), (1003, "rare words", "few", "a"), (1004, "rare", "few", "b"), (rows[0]), (rows[0])]
    return rows + [(2000, "long " * 30000, "en", "s1"), (None, "beta beta", "en", "s2")]


def test_divergence_equals_brute_force(spark):
    rows = audit_rows()
    want = brute_audit(rows)
    assert audited(spark, rows) == want
    # many shards and waves, dense arrays given out again and again, small blocks
    assert audited(spark, rows, per_shard=4, wave_bytes=1, dense_slots=6, block_counts=5) == want
    assert [r for r in want if r[0] == "only"] and all(r[4] == 0 for r in want if r[0] == "few")


def test_divergence_top_and_empty(spark):
    rows = audit_rows(60, 9)
    assert audited(spark, rows, top=3) == brute_audit(rows, top=3)
    assert audited(spark, rows, least=1) == brute_audit(rows, least=1)
    assert audited(spark, []) == []


def test_probability_is_exact():
    rnd = random.Random(2)
    total = [rnd.randint(1, 10 ** rnd.randint(1, 15)) for _ in range(2000)]
    count = [rnd.randint(1, t) for t in total]
    got = divergence.probability(np.array(count), np.array(total))
    assert got.tolist() == [1 + 1_000_000_000 * c // t for c, t in zip(count, total)]


def test_two_terms_of_one_key_are_told_apart():
    batch = pa.RecordBatch.from_pydict({"text": ["aa bb aa", "bb"], "lang": ["l", "l"]})
    real = textops.word_keys
    try:
        textops.word_keys = lambda buf, start, end: np.array(end - start, np.uint64)
        got = [r for b in divergence._frequencies(iter([batch])) for r in b.to_pylist()]
    finally:
        textops.word_keys = real
    assert sorted((r["term"], r["n"]) for r in got) == [("aa", 1), ("bb", 2)]


# ---- op12 --------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, label int, score int, `row` string, slot int, positives string"


def brute_negatives(rows, anchors, many=5, hard=10):
    sound = [(i, v, y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in sound]
    out = []
    last = lambda i: (i is None, i or 0)
    for k, (a, av, y) in enumerate(q):
        if a is None or not anchors(a):
            continue
        score = [(sum(x * z for x, z in zip(av, v)), i, lab) for i, v, lab in q]
        pos = sorted(((s, i) for j, (s, i, lab) in enumerate(score) if j != k and lab == y), key=lambda x: (-x[0], last(x[1])))[:many]
        for ps, p in pos:
            neg = sorted(((s, i) for s, i, lab in score if lab != y and 30 * ps <= 100 * s <= 90 * ps), key=lambda x: (-x[0], last(x[1])))[:hard]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(neg)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], VECS)
    return sorted((tuple(r) for r in hard_negatives.mine(df.repartition(3), anchor=F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def vectors(n=150, d=8, labels=3, seed=3, scale=0.4):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, scale) for _ in range(d)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, scale / 3) for x in rnd.choice(base)], rnd.randrange(labels)) for i in range(n)]
    rows += [(200, None, 1), (210, [0.1, None] + [0.0] * (d - 2), 1), (220, [float("nan")] * d, 0), (230, [float("inf")] * d, 0), (240, [0.2] * d, None)]
    rows += [(250, [0.3] * (d - 3), 1), (260, [], 2), (None, base[0], 1), (270, [0.0] * d, 1), (20, base[1], 0), rows[30], rows[30]]
    return rows


@pytest.mark.parametrize("options", [{}, {"group_rows": 20, "group_anchors": 4, "least_rows": 10}])
def test_hard_negatives_equal_brute_force(spark, options):
    rows = vectors()
    assert mined(spark, rows, **options) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_ties_labels_and_large_components(spark):
    same = [(i, [0.5, 0.25], i % 2) for i in range(60)]  # all scores equal: no row within 90 %
    assert mined(spark, same) == brute_negatives(same, lambda i: i % 10 == 0) == []
    tied = [(i, [0.5, 0.1] if i % 2 else [0.5, 0.5], i % 2) for i in range(60)]
    want = brute_negatives(tied, lambda i: i % 10 == 0)
    assert want and mined(spark, tied, group_rows=16, least_rows=8) == want
    own = [(i, v, i) for i, v, _ in vectors(40, seed=8)[:40]]  # every label but once: no positives
    assert mined(spark, own) == []
    wide = [(i, [x * 3e4 for x in v], y) for i, v, y in vectors(60, seed=6)[:60]]
    assert mined(spark, wide) == brute_negatives(wide, lambda i: i % 10 == 0)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1)])
    assert mined(spark, []) == [] and mined(spark, [(0, None, 1)]) == []


@pytest.mark.parametrize("scale", [1, 3, 256, 40_000, 10 ** 8])
def test_packed_products_are_exact(scale):
    rng = np.random.default_rng(scale)
    for n, d in ((1, 1), (7, 3), (100, 32)):
        v, a = rng.integers(-scale, scale + 1, (n, d)), rng.integers(-scale, scale + 1, (5, d))
        most = max(int((x.astype(object) ** 2).sum(axis=1).max()) for x in (v, a)) + 1
        if most < 1 << 62:
            assert (hard_negatives.Packed(v, most).scores(a) == a.astype(object) @ v.T.astype(object)).all()
    # the extremes of every field, next to each other
    v = np.array([[scale], [-scale]] * 9)
    assert (hard_negatives.Packed(v, scale * scale).scores(np.array([[scale], [-scale], [0]])) == np.array([[scale], [-scale], [0]]) * v.T).all()


def test_packing_puts_several_candidates_in_a_word():
    v = np.random.default_rng(0).normal(0, 0.125, (50, 64))
    q = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    p = hard_negatives.Packed(q, int((q ** 2).sum(axis=1).max()))
    assert p.fields == 3 and p.words.shape == (64, 17)


# ---- op13 --------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, `first` int, payload string, n int"
LONG = "<p>" + "ä" * 60 + "</p>"


def page_rows():
    return [(5, "http://a/", LONG), (3, "http://b/", LONG), (9, None, LONG), (1, "http://c/", "short"), (2, "http://d/", "short"), (4, "http://e/", None), (6, "", ""),
            (7, "http://x/\r\nWARC-Type: evil\r\n\r\n", "x" * 99), (8, "http://x/", "x" * 99), (10, "http://y/", "x" * 100), (11, "http://y/", "x" * 100),
            (12, "http://z/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (3, "http://b/", LONG), (None, "http://n/", LONG), (None, "http://m/", "y" * 150), (None, "http://m/", "y" * 150),
            (13, "http://long/", "z" * 3_000_000), (-4, "http://neg/", "z" * 3_000_000)]


def brute_pages(rows, least=100):
    first, many = {}, {}
    for i, _, t in rows:
        t = t or ""
        many[t] = many.get(t, 0) + 1
        if i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        t = t or ""
        raw = t.encode()
        again = len(raw) >= least and many[t] > 1 and t in first and first[t] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p", 2) for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"maxFileBytes": "500", "level": "1"}])
def test_pages_round_trip(spark, tmpdir_path, options):
    path = f"{tmpdir_path}/warc"
    for _ in range(2):  # a second write replaces the first
        warc.write_pages(pages(spark, page_rows()), path, **options)
    got = sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str)
    assert got == brute_pages(page_rows())
    names = os.listdir(path)
    assert "_temporary" not in names and "_SUCCESS" in names
    assert all(n.endswith(".warc" if "compression" in options else ".warc.gz") for n in names if n[0] not in "._")
    if "maxFileBytes" in options:
        assert len(names) > 5


def test_archives_are_standard_gzip_members(spark, tmpdir_path):
    path = f"{tmpdir_path}/warc"
    warc.write_pages(pages(spark, page_rows()).coalesce(1), path)
    (name,) = [n for n in os.listdir(path) if n.endswith(".gz")]
    data = gzip.open(f"{path}/{name}").read()
    # read by hand, header by header
    at, kinds = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + int(fields["Content-Length"])
        assert data[at: at + 4] == b"\r\n\r\n"
        at += 4
    assert kinds.count("warcinfo") == 1 and kinds.count("revisit") == sum(r[3] == "revisit" for r in brute_pages(page_rows()))


def test_empty_pages(spark, tmpdir_path):
    path = f"{tmpdir_path}/warc"
    warc.write_pages(pages(spark, []), path)
    assert warc.page_records(spark, path).collect() == []
    warc.register(spark)
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("warc").load(f"{tmpdir_path}/nothing").count()


def foreign(path, packed):
    """An archive by another writer: folded and repeated headers, other names' case, no skip lengths."""
    recs = [b"WARC/1.0\r\nwarc-type: request\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http;msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nWARC-Target-URI: http://t/\r\n more\r\nX-A: 1\r\nX-A: 2\r\nContent-Type: application/http\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\nbyt",
            b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <c>\r\nContent-Type: text/plain\r\nContent-Length: 0\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <d>\r\nContent-Length: 70000\r\n\r\n" + os.urandom(70000)]
    recs[1] = recs[1].replace(b"Content-Length: 25", b"Content-Length: %d" % len(recs[1].split(b"\r\n\r\n", 1)[1]))
    with open(path, "wb") as f:
        for r in recs:
            f.write(gzip.compress(r + b"\r\n\r\n") if packed else r + b"\r\n\r\n")
    return recs


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmpdir_path, packed):
    file = f"{tmpdir_path}/x.warc{'.gz' if packed else ''}"
    recs = foreign(file, packed)
    warc.register(spark)
    rows = spark.read.format("warc").load(tmpdir_path).orderBy("offset").collect()
    assert [r.record_type for r in rows] == ["request", "response", "resource", "metadata"]
    assert rows[1].target_uri == "http://t/ more" and rows[1].headers == {"X-A": "1, 2"}
    assert rows[1].http_head == "HTTP/1.1 200 OK\r\n\r\n" and bytes(rows[1].payload) == b"\r\n\r\nbyt" and rows[1].payload_length == 7
    assert bytes(rows[2].payload) == b"" and bytes(rows[3].payload) == recs[3][-70000:]
    assert [r.file for r in rows] == [file] * 4 and rows[0].offset == 0


def test_filters_are_pushed_down_and_unwanted_payloads_stay_packed(spark, tmpdir_path):
    path = f"{tmpdir_path}/warc"
    warc.write_pages(pages(spark, page_rows()).coalesce(1), path)
    df = spark.read.format("warc").load(path).filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan  # nothing is left for Spark to filter
    assert [r.headers["X-Page-ID"] for r in df.collect()] == ["5"]
    kept = spark.read.format("warc").load(path).filter("payload_length > 1000000 AND record_type = 'response'")
    assert sorted(r.headers["X-Page-ID"] for r in kept.collect()) == ["-4"]
    # with a member's body destroyed, its header is still read and the record passed over
    (name,) = [f"{path}/{n}" for n in os.listdir(path) if n.endswith(".gz")]
    rows = list(warc.records(name, lambda r: True, ["record_type"]))
    big = next(r for r in rows if r["headers"].get("X-Page-ID") == "-4")
    with open(name, "r+b") as f:
        f.seek(big["offset"] + 1500)
        f.write(b"\xff" * 500)
    assert len(list(warc.records(name, lambda r: r["headers"].get("X-Page-ID") != "-4", ["payload"]))) == len(rows) - 1
    with pytest.raises(ValueError, match=f"at {big['offset']}"):
        list(warc.records(name, lambda r: True, ["payload"]))


def test_files_are_planned_into_partitions(tmpdir_path):
    for i, size in enumerate((10, 500, 60, 40, 5)):
        with open(f"{tmpdir_path}/{i}.warc", "wb") as f:
            f.write(b"x" * size)
    os.makedirs(f"{tmpdir_path}/_temporary/a")
    open(f"{tmpdir_path}/_temporary/a/9.warc", "wb").write(b"x")
    open(f"{tmpdir_path}/notes.txt", "wb").write(b"x")
    got = [[os.path.basename(f) for f in x] for x in warc.plan_files(tmpdir_path, 100)]
    assert got == [["1.warc"], ["2.warc", "3.warc"], ["0.warc", "4.warc"]]


def test_truncated_archive_is_reported(spark, tmpdir_path):
    file = f"{tmpdir_path}/x.warc"
    foreign(file, False)
    with open(file, "r+b") as f:
        f.truncate(os.path.getsize(file) - 100)
    with pytest.raises(ValueError, match="x.warc at"):
        list(warc.records(file, lambda r: True, ["payload"]))
