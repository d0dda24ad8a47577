import random
import re
import tempfile
import textwrap
from collections import Counter

import duckdb
import pytest

from tessera.llm import common, decontaminate, licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for item, text in items:
            q = words(text)
            if not q:
                continue
            k = min(5, len(q))
            bag = lambda x: Counter(tuple(x[i: i + k]) for i in range(len(x) - k + 1))
            want = bag(q)
            for s in range(len(w) - len(q) + 1):
                got = bag(w[s: s + len(q)])
                sim = sum((got & want).values()) / sum((got | want).values())
                if sim >= 0.8:
                    best = out.get((d, item))
                    if best is None or (-sim, s) < (-best[2], best[0]):
                        out[d, item] = (s, len(q), sim)
    return out


def test_windows_match_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 12, 40, 40, 55])] + [(20, ""), (21, None), (5, text(30)), (None, text(25)), (22, " ".join(["same"] * 20))]
    docs = [(None, text(30)), (0, None), (1, ""), (2, "..."), (3, items[5][1]), (4, "Same " * 50)]
    for i in range(60):
        item = rnd.choice([t for _, t in items if t]).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            item[rnd.randrange(len(item))] = "edit"
        if rnd.random() < 0.3 and len(item) > 10:
            del item[rnd.randrange(len(item))]
        docs.append((10 + i, text(rnd.randint(0, 40)) + ", " + "! ".join(item).upper() + "\n" + text(rnd.randint(0, 40))))
    docs += [docs[-1], docs[-2]]
    d = spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id long, text string, key int, item string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.annotate(d, b).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys()
    assert all(got[x][:2] == want[x][:2] and got[x][2] == pytest.approx(want[x][2]) for x in want)
    out = decontaminate.clean(d, b)
    assert out.columns == d.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(x) for x, _ in docs if not any(x == y for y, _ in want))


def test_documents_shorter_than_an_item(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(vocab) for _ in range(n)]) for i, n in enumerate([5, 6, 9, 12, 37, 60])] + [(9, ["same"] * 20), (10, ["a", "b", "c"])]
    docs = []
    for _, q in items:
        docs += [q[:n] for n in range(len(q) + 1)] + [q[n:] for n in range(1, 12)] + [q[:-2] + ["edit"], q[:9] + q[10:]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = {}
    for d, t in docs:
        for item, q in items:
            k, w = min(5, len(q)), words(t)
            bags = [Counter(tuple(x[i: i + k]) for i in range(len(x) - k + 1)) for x in (w, q)]
            sim = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
            if len(w) <= len(q) and sim >= 0.8:
                want[d, item] = (0, len(q), sim)
    assert sum(len(words(docs[d][1])) < n for (d, _), (_, n, _) in want.items()) > 20
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.annotate(d, b).collect()}
    assert got.keys() == want.keys()
    assert all(got[x][:2] == want[x][:2] and got[x][2] == pytest.approx(want[x][2]) for x in want)
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_no_documents_or_items(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.annotate(d.limit(0), b).count() == 0
    assert decontaminate.annotate(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == 1 and decontaminate.clean(d, b).count() == 0


def py_bits(hashes):
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in hashes) * 2 > len(hashes))


def test_simhash_bits(spark):
    rnd = random.Random(4)
    hashes = [[rnd.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 9, 10, 127, 128, 254, 255, 256, 400)]
    rows = spark.createDataFrame([(h,) for h in hashes], "h array<long>").select("h", decontaminate.simhash(common.F.col("h")).alias("fp")).collect()
    for r in rows:
        assert r.fp & (2**64 - 1) == py_bits([x & (2**64 - 1) for x in r.h]), len(r.h)


def test_index_finds_every_fingerprint_within_the_radius(spark):
    F, rnd = common.F, random.Random(6)
    sizes = decontaminate.blocks()
    assert len(sizes) == 11 and sum(b for *_, b in sizes) == 128 and {b for *_, b in sizes} <= {10, 11, 12, 13}
    items, prints = [], []
    signed = lambda x: [(v if v < 1 << 63 else v - (1 << 64)) for v in (x >> 64, x & (2**64 - 1))]
    for i in range(300):
        x = rnd.getrandbits(128)
        items.append((i, 10, 5, signed(x)))
        y = x
        for b in rnd.sample(range(128), rnd.choice([0, 5, 20, 31, 32])):
            y ^= 1 << b
        prints.append((10, 5, signed(y), i))
    bench = spark.createDataFrame(items, "item long, n int, k int, fp array<long>")
    asked = spark.createDataFrame(prints, "n int, k int, fp array<long>, i long")
    for some in (asked, asked.filter("i < 40")):  # either side may be the one that is filed
        got = decontaminate.near_items(some.select("n", "k", "fp"), bench).join(some, ["n", "k", "fp"])
        assert {(r.i, r.item) for r in got.collect()} >= {(r.i, r.i) for r in some.collect()}
    with pytest.raises(ValueError):
        decontaminate.near_items(asked, bench, 33)


def test_a_window_meets_few_of_a_hundred_thousand_items(spark):
    F = common.F
    size = (F.col("id") % 50 + 20).cast("int")
    bench = spark.range(100_000).select(F.col("id").alias("item"), size.alias("n"), F.lit(5).alias("k"), F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("fp"))
    # each print differs from one item in a few bits
    off = F.array(F.col("fp")[0].bitwiseXOR(F.lit(0x1000010000100)), F.col("fp")[1].bitwiseXOR(F.lit(0x10101)))
    prints = bench.filter("item % 5000 = 0").select("n", "k", off.alias("fp"))
    found = decontaminate.near_items(prints, bench)
    assert sorted(r.item for r in found.collect()) == list(range(0, 100_000, 5000))
    left = prints.select("n", "k", "fp", decontaminate._filed(True).alias("x")).select("n", "k", "fp", "x.block", "x.value")
    right = bench.select("n", "k", decontaminate._filed(False).alias("x")).select("n", "k", "x.block", "x.value")
    joined = left.join(right, ["n", "k", "block", "value"]).count()
    assert joined / 20 < 1000  # of 100,000 items, 2,000 of them of the window's size


def test_recall_of_the_radius(spark):
    """Items with changed words: nearly all pairs of a similarity of 0.8 and more lie within the radius."""
    F, rnd = common.F, random.Random(11)
    pairs = []
    for _ in range(1500):
        q = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(14, 60))]
        v = list(q)
        kind = rnd.random()
        if kind < 0.7:
            v[rnd.randrange(len(v))] = "edit"
        elif kind < 0.9:
            n = rnd.randint(1, 3)
            v = v[n:] + [f"e{i}" for i in range(n)]
        else:
            v = v[:-rnd.randint(1, 3)]
        bag = [Counter(tuple(x[i: i + 5]) for i in range(len(x) - 4)) for x in (q, v)]
        if sum((bag[0] & bag[1]).values()) / sum((bag[0] | bag[1]).values()) >= 0.8:
            pairs.append((" ".join(q), " ".join(v)))
    df = spark.createDataFrame(pairs, "a string, b string")
    fp = lambda c: common.let(decontaminate.shingles(decontaminate.words(c), F.lit(5)), decontaminate.fingerprint)
    far = df.select(decontaminate.distance(fp("a"), fp("b")).alias("d")).toPandas().d
    assert len(far) > 500 and (far <= decontaminate.RADIUS).mean() >= 0.995


def test_native_plan(spark):
    d = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    for df in (licenses.annotate(d), decontaminate.annotate(d, d.selectExpr("doc_id AS item_id", "text"))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_license(text):
    w = WORD.findall((text or "").translate(LOW))
    spots = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i: i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in spots}, 0.0
    for i, label, tokens in licenses._template_sets():
        span, own = 2 * len(licenses.TEMPLATES[i][1].split()), set(tokens)
        share = max((len(set(w[a: a + span]) & own) for a in range(len(w)) if w[a] in own), default=0) / len(tokens)
        if share >= 0.9 - 1e-12:
            labels.add(label)
            best = max(best, share)
    at = [i for i, _ in spots]
    return (len(w), len(spots), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in spots})), ",".join(sorted(labels)), 1.0 if spots else best)


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def by_sql(sql, path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return [dict(zip(names, r)) for r in res.fetchall()]


def test_license_scan_matches_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", "...", "MIT\nLicense", "the MIT-license and the mit license, Apache License", "x " * 50_000 + "General Public License", "license mit", "mitlicense", "Licensed under CC BY-NC 4.0.", "by 4.0 nc under cc licensed", "licensed under cc by\nnc 4.0", "MIT lİcense \u212a", "\u212alicensed under CC BY-NC 4.0"]
    for _, t in licenses.TEMPLATES:
        parts = t.split()
        texts += [t, t.upper(), "foo\n" + t + " bar", " ".join(parts[1:]), " ".join(rnd.sample(parts, len(parts)))]
        if len(parts) > 12:
            texts.append(" ".join(parts[2:]))
    data = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in data], "doc_id long, text string, label string, `row` int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in licenses.annotate(d).collect()), key=str)
    assert got == sorted(((a, *brute_license(b)) for a, b in data), key=str)
    assert licenses.annotate(d.limit(0)).count() == 0


def test_notices_over_line_breaks_and_in_long_lines(spark):
    rnd = random.Random(8)
    vocabulary = sorted({t for _, _, s in licenses._template_sets() for t in s})
    prose = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    wrap = lambda t, width, start: "\n".join(start + x for x in textwrap.wrap(t, width))
    texts = [None, "", "...", "licensed under cc by\nnc 4.0"]
    for _, t in licenses.TEMPLATES:
        texts += [wrap(t, 30, ""), wrap(t, 79, " * "), " ".join(prose(rnd.randrange(300))) + "\n" + wrap(t, 40, "# ") + "\n" + " ".join(prose(90))]
        scattered = t.split()
        for at in range(len(scattered) - 1, 0, -1):
            scattered[at:at] = prose(12)
        texts.append(" ".join(scattered))
    texts += [" ".join(prose(n) + licenses.TEMPLATES[6][1].split() + prose(3_000)) for n in range(40, 60)]
    texts += [" ".join(rnd.choice(vocabulary) if rnd.random() < 0.6 else "x" for _ in range(900)) for _ in range(12)]

    want = {i: brute_license(t) for i, t in enumerate(texts)}
    assert all(label in want[4 + 4 * i + j][5].split(",") for i, (label, _) in enumerate(licenses.TEMPLATES) for j in range(3))
    assert want[3][5:] == ("cc-by-nc", 1.0) and want[4 + 4 * 6 + 3][5:] == ("", 0.0)
    path = tempfile.mkdtemp(prefix="tessera-test-")
    rows = [*enumerate(texts), (2, texts[7]), (5, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op3_license_scan(spark, path).collect()), key=str)
    assert got == sorted(((i, *brute_license(t)) for i, t in rows), key=str)
    # the SQL has the same rule
    assert sorted((tuple(r[c] for c in COLUMNS) for r in by_sql(licenses.oracle(), path, "documents")), key=str) == got


def test_sql_of_decontamination_has_the_same_rule(spark):
    rnd = random.Random(12)
    items = [[f"w{rnd.randrange(80)}" for _ in range(n)] for n in (5, 6, 9, 12, 37, 60)]
    docs = [" ".join(q[:-n]) for q in items for n in (1, 2, 4, 9) if n < len(q)] + [" ".join(["x"] * 30 + q + ["y"] * 7) for q in items] + [None, ""]
    path = tempfile.mkdtemp(prefix="tessera-test-")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = queries.op1_decontamination(spark, path)
    rows = sorted((r.asDict() for r in got.collect()), key=str)
    assert len(rows) > 10 and rows == sorted(({c: r[c] for c in got.columns} for r in by_sql(decontaminate.ORACLE, path, "documents", "benchmark")), key=str)
