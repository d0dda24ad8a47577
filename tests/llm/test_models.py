import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, langid, pitman_yor, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(None, "null id"), (1, None), (2, ""), (3, "..."), (4, "word"), (4, "word"), (5, "Über naïve 日本語"), (6, "long " * 60_000)]


def edges(spark):
    return spark.createDataFrame([(d, t, "en", "s", 1, 0.5, "k") for d, t in EDGES], "doc_id long, text string, lang string, source string, y int, score double, key string")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]


def held(d, n, r):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n == r


# ---- language model


def base_scores(rows):
    c = Counter()
    for d, t in rows:
        if not held(d, 10, 0):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(held(d, 10, 0), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows]


def test_lm_base_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = dict(zip((d for d, _ in rows), base_scores(rows)))
    got = queries.op4_lm_scoring(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)  # a better model: nearer to zero
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_lm_edges(spark):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in pitman_yor.annotate(edges(spark)).collect()), key=str)
    assert got == sorted(((d, *x[:4], round(x[4], 6)) for (d, _), x in zip(EDGES, base_scores(EDGES))), key=str)
    assert pitman_yor.annotate(edges(spark).limit(0)).count() == 0


def test_lm_without_training_rows(spark):
    d = next(i for i in range(100) if held(i, 10, 0))
    (r,) = pitman_yor.annotate(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0.0, abs=1e-6)  # all is the one unknown word


def seated(seed=0, words=30):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 9, words)
    context = np.concatenate([np.sort(rng.choice(pitman_yor.LEAVES, n, replace=False)) for n in size])
    return pitman_yor.Seating(size, context, rng.integers(1, 50, len(context)))


def test_predictive_probabilities_sum_to_one():
    seats = seated()
    words, d = len(seats.parents), np.array([0.5, 0.6, 0.7])
    rng = np.random.default_rng(1)
    for _ in range(3):
        totals = pitman_yor.Totals()
        totals.add(seats)
        base = 1 / (words + 1)
        p, gamma = seats.predictive(totals, d, base), totals.gamma(d)
        assert p[0].sum() + gamma[0][0] * base == pytest.approx(1)
        for parent in np.unique(seats.place[1]):  # seen words, and others through the root
            here = seats.place[1] == parent
            rest = 1 - p[0][seats.up[1][here]].sum()
            assert p[1][here].sum() + gamma[1][parent] * rest == pytest.approx(1)
        seats.sweep(totals, d, base, rng)
        assert all((t <= c).all() and (t >= 1).all() for t, c in zip(seats.tables, seats.customers))
        assert seats.customers[1].sum() == seats.tables[2].sum() and seats.customers[0].sum() == seats.tables[1].sum()


def test_tables_follow_the_restaurant_process():
    rng = np.random.default_rng(3)
    c, p, d, others = 30, 0.05, 0.5, 10.0

    def one():
        t = 1
        for i in range(1, c):
            pull = (1 + d * others) * p
            t += rng.random() < pull / (pull + i - d * t)
        return t

    want = np.mean([one() for _ in range(4000)])
    got = pitman_yor.tables(np.full(4000, c), np.full(4000, p), d, others, rng)
    assert got.mean() == pytest.approx(want, abs=0.12)
    assert (pitman_yor.tables(np.array([0, 1]), np.full(2, 0.1), d, 1.0, rng) == [0, 1]).all()


# ---- quality


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    texts = pa.array(["one two three two", "ALL!! CAPS!! 12", "", None, "x | y | z\nx | y"])
    feats = quality.features(texts)
    m = quality.Model()
    m.weight, m.vectors, m.bias = rng.normal(size=len(m.weight)), rng.normal(size=m.vectors.shape), 0.3
    rows, place, value, z = m._inputs(feats)
    raw, _ = m._parts(rows, place, value, z)
    for i in range(len(texts)):
        x = np.zeros(len(m.weight))
        np.add.at(x, place[rows[i]: rows[i + 1]], 0)
        index, val = list(place[rows[i]: rows[i + 1]]) + list(range(quality.PLACES, len(x))), list(value[rows[i]: rows[i + 1]]) + list(z[i])
        pairs = sum(m.vectors[index[a]] @ m.vectors[index[b]] * val[a] * val[b] for a in range(len(index)) for b in range(a))
        assert raw[i] == pytest.approx(m.bias + sum(m.weight[j] * v for j, v in zip(index, val)) + pairs)


def accuracy(got, label):
    return np.mean([r.predicted == r[label] for r in got])


def test_quality_held_out(spark):
    labels = common.table(spark, SF, "labels")
    got = queries.op6_quality_classifier(spark, SF)
    assert got.count() == common.table(spark, SF, "documents").count()
    out = got.filter("held_out").join(labels.filter("quality is not null"), "doc_id").collect()
    assert accuracy(out, "quality") > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1) and r.predicted == (r.score >= 0.5) for r in got.collect())


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 0, 0, "x"), (2, 1, 0, "x"), (2, 0, 0, "x"), (4, None, None, "x"), (None, 1, 1, "x"), (5, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for annotate, n, r in ((quality.annotate, 3, 1), (toxicity.annotate, 4, 2)):
        got = annotate(edges(spark), labels).collect()
        assert sorted(str(x.doc_id) for x in got) == sorted(str(d) for d, _ in EDGES)
        assert all(0 <= x.score <= 1 and x.held_out == held(x.doc_id, n, r) for x in got)
        assert len({x.score for x in got if x.doc_id == 4}) == 1
        assert annotate(edges(spark), labels.limit(0)).count() == len(EDGES)
        assert annotate(edges(spark).limit(0), labels).count() == 0


# ---- language


def test_language_held_out(spark):
    docs = common.table(spark, SF, "documents")
    got = queries.op8_language_id(spark, SF)
    assert got.count() == docs.count()
    out = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got.collect())


def test_language_edges(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.annotate(edges(spark)).collect()}
    assert got == {(None, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (6, "en")}
    assert langid.annotate(edges(spark).limit(0)).count() == 0
    none = edges(spark).withColumn("lang", common.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.annotate(none).collect()} == {"und"}


SCRIPTS = {"x": "abc ", "y": "abdé ", "z": "".join(chr(0x4E00 + i) for i in range(60)) + " "}


def four_grams(spark, texts):
    """Counts of four characters, one by one."""
    import unicodedata
    out = {}
    for lang, t in texts:
        clean = "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in t)
        clean = re.sub(" +", " ", clean)
        chars = [0] * 4 + [0 if c == " " else ord(c) for c in (clean[1:] if clean[:1] == " " else clean)]
        for i in range(4, len(chars)):
            k = (lang, (chars[i - 3] << 42) | (chars[i - 2] << 21) | chars[i - 1], chars[i])
            out[k] = out.get(k, 0) + 1
    return out


def test_four_grams_equal_counting_one_by_one():
    rnd = random.Random(3)
    wide = [chr(c) for c in (*range(97, 123), 0xE9, 0xC9, 0xDF, 0x301, 0x4E00, 0x4E8C, 0x939, 0x93F, 0x1F600)] + [" ", ".", "7", "\n"]
    texts = [("l", "".join(rnd.choice(wide) for _ in range(rnd.randint(0, 60)))) for _ in range(80)] + [("l", ""), ("l", "...  "), ("m", "Ab, c")]
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in texts], "lang": [x for x, _ in texts]})
    got = {}
    for b in langid._counts(iter([batch.slice(0, 40), batch.slice(40)])):
        got.update({(r["lang"], r["context"], r["last"]): r["n"] for r in b.to_pylist()})
    assert got == four_grams(None, texts)


def brute_kneser_ney(cells, lang, letters):
    """Probabilities by the textbook: prob(context tuple, char)."""
    counts = {4: {}}
    for (one, context, last), n in cells.items():
        if one == lang:
            counts[4][((context >> 42), (context >> 21) & (2**21 - 1), context & (2**21 - 1)), last] = n
    for k in (3, 2, 1):
        counts[k] = {}
        for context, last in counts[k + 1]:
            counts[k][context[1:], last] = counts[k].get((context[1:], last), 0) + 1

    def prob(context, c, k):
        if k == 0:
            return 1 / (letters + 1)
        ones, twos = (sum(n == v for n in counts[k].values()) for v in (1, 2))
        d = min(0.95, max(1, ones) / (max(1, ones) + 2 * twos))
        after = {w: n for (h, w), n in counts[k].items() if h == context}
        if not after:
            return prob(context[1:], c, k - 1)
        total = sum(after.values())
        gamma = 1 - sum(max(n - d, 0) for n in after.values()) / total
        return max(after.get(c, 0) - d, 0) / total + gamma * prob(context[1:], c, k - 1)

    return prob


@pytest.fixture(scope="module")
def kneser_ney(spark):
    rnd = random.Random(1)
    texts = [(one, "".join(rnd.choice(letters) for _ in range(300))) for one, letters in SCRIPTS.items()]
    cells = four_grams(None, texts)
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "lang string, context long, last int, n long")
    letters = len({k[2] for k in cells})

    def model(most):
        own, contexts = langid.tables(df, most)
        return langid.Model(own.toArrow(), contexts.toArrow(), letters)
    return cells, letters, model


def test_kneser_ney_equals_the_textbook(kneser_ney):
    cells, letters, model = kneser_ney
    m, rnd = model(10_000), random.Random(5)
    assert m.langs == ["x", "y", "z"]
    chars = sorted({k[2] for k in cells})
    for lang in m.langs:
        prob = brute_kneser_ney(cells, lang, letters)
        asked = [[rnd.choice(chars[:8] if lang != "z" else chars) for _ in range(4)] for _ in range(60)]
        got = np.exp(m.look(lang, np.array(asked, np.uint64)))
        assert got == pytest.approx([prob(tuple(a[:3]), a[3], 4) for a in asked], rel=1e-5)


@pytest.mark.parametrize("most", [10_000, 150])
def test_kneser_ney_sums_to_one(kneser_ney, most):
    cells, letters, model = kneser_ney
    m = model(most)
    assert sum(len(g[4][0]) for g in m.grams.values()) <= max(most, 0) and (most == 150 or len(m.grams["z"][4][0]) > 200)
    chars = sorted({k[2] for k in cells}) + [0x10FFFF]  # and one unknown
    for context in ([0, 0, 0], [97, 98, 99], [0x4E00, 0x4E01, 0x4E02], [120, 120, 120], [0, 97, 98]):
        for lang in m.langs:
            p = np.exp(m.look(lang, np.array([[*context, c] for c in chars], np.uint64)))
            assert p.sum() == pytest.approx(1, rel=1e-5)


def test_scripts_of_many_letters(spark):
    """Two languages of one script with thousands of letters, told apart by their sequences."""
    rnd = random.Random(9)
    han = [chr(0x4E00 + i) for i in range(3000)]
    after = {one: {c: [rnd.choice(han) for _ in range(3)] for c in han} for one in ("za", "zb")}

    def text(one, n):
        out = [rnd.choice(han)]
        while len(out) < n:
            out.append(rnd.choice(after[one][out[-1]]) if rnd.random() < 0.9 else rnd.choice(han))
        return "".join(out)
    rows = [(i, text(("za", "zb")[i % 2], 400), ("za", "zb")[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.annotate(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in out if r.held_out]) > 0.97
    assert langid.grams(pa.array(["一丁七"]))[0].tolist()[-1] == [0, 0x4E00, 0x4E01, 0x4E03]


def test_waves_answer_as_one_model(spark):
    """No n-gram is left out however large the model is, and its waves' answers are those of the whole."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang").limit(150)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "and so on", "en"), (-5, None, "en"), (-6, " ", "en")], "doc_id long, text string, lang string"))
    assert not hasattr(langid, "MODEL_CELLS")
    one, many = langid.fit(docs), langid.fit(docs, wave=2_000)
    assert type(one) is langid.Model and isinstance(many, langid.Waves) and len(many.waves) > 3
    assert (many.letters, many.langs, many.temperature) == (one.letters, one.langs, one.temperature) and many.bound == pytest.approx(one.bound)
    parts = list(many.models())
    assert sum(len(m.grams[x][4][0]) for m in parts for x in m.langs) == sum(len(one.grams[x][4][0]) for x in one.langs)
    got, want = (sorted(map(tuple, langid.predict(docs, m).collect()), key=str) for m in (many, one))
    assert len(got) == docs.count() and [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)


def test_grams_do_not_depend_on_the_batch():
    texts = ["", "Ab, c", None, "  é!!x ", "9"]
    together, which, off, letters = langid.grams(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own, at, _, n = langid.grams(pa.array([t], pa.string()))
        assert together[which[off[i]: off[i + 1]]].tolist() == own[at].tolist() and n[0] == letters[i] == sum(c.isalpha() for c in t or "")


# ---- toxicity


def distance(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_matches_edit_distance():
    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randint(3, 11))) for _ in range(40)})
    words = ["", "a", *("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 12))) for _ in range(900))]
    for t in terms:
        for _ in range(3):
            w = t
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(w))
                w = rnd.choice([w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i: i + 2][::-1] + w[i + 2:]]) or "z"
            words += [t, w, t + "q" * 30]
    only = set(terms[::7])
    term, edits = toxicity.Trie(terms, only).match(words)
    for w, i, e in zip(words, term.tolist(), edits.tolist()):
        near = 0 if w in terms else min((d for t in terms if t not in only and len(w) >= toxicity.EDIT_FROM - 1 and (d := distance(w, t)) <= toxicity.allowed(len(t))), default=9)
        assert e == near, w
        assert (i >= 0) == (e < 9) and (e == 9 or distance(w, terms[i]) == e)
    assert [toxicity.allowed(n) for n in (3, 4, 7, 8, 20)] == [0, 1, 1, 2, 2]
    assert toxicity.Trie(["scum", "worthless"]).match(["scvm", "scuum", "wrothles", "wortless", "worhtles", "sc"])[1].tolist() == [1, 1, 2, 1, 2, 9]


def test_quotations_hold_in_their_paragraph():
    q = lambda t: [t.encode()[a:b].decode() for a, b in toxicity.quotations(t.encode())]
    assert q('he "a b" and "c" d') == ['"a b', '"c']
    assert q("„a“ b “c” d «e» f “g“") == ["„a", "“c", "«e", "“g"]
    assert q('a 5" pipe\n\n"b" c') == ['"b'] and q('"over\ntwo lines" x') == ['"over\ntwo lines']
    assert q("» a « b » c ” d „ e") == ["« b "] and q('"') == [] and q("") == []


LEXICON = {"idiot": 0.99, "worthless": 0.99, "scum": 0.99}


def test_context_parts_quotation_from_abuse():
    lex = toxicity.Lexicon(LEXICON, harmless={"idiom"})
    x = lex.spot(pa.array(['you are an idiot', 'the word "idiot" was there', "an idiom is fine", "an 1diot", None, "idoit"]))
    assert x["doc"].tolist() == [0, 1, 3, 5]
    assert x["edits"].tolist() == [0, 0, 1, 1] and x["quoted"].tolist() == [False, True, False, False] and x["aimed"].tolist() == [True, False, False, False]
    m = toxicity.Model(lex)
    p = m.score(pa.array(["you idiot", 'she said "idiot"', "nothing"]))
    assert p[0] > p[1] >= p[2]
    # both marks far from the term
    far = 'They wrote "all of these many words and then idiot and many more words to the end" here'
    assert lex.spot(pa.array([far]))["quoted"].tolist() == [True]
    assert lex.spot(pa.array([far.replace('"', "")]))["quoted"].tolist() == [False]
    assert lex.spot(pa.array(['a stray " mark\n\nyou idiot and "more"']))["quoted"].tolist() == [False]


def misspellings(t):
    i = len(t) // 2
    out = [t[:i] + "q" + t[i + 1:], t[:i] + t[i + 1:], t[:i] + t[i] + t[i:], t[:i] + t[i + 1] + t[i] + t[i + 2:]]
    return out + ([t[:2] + "q" + t[3:-1] + "q"] if toxicity.allowed(len(t)) == 2 else [])


def check_misspelled_and_quoted(model):
    terms = [t for t in model.lexicon.terms if t not in model.lexicon.exact and t.isascii() and 4 <= len(t) <= 10][:12]
    assert len(terms) >= 8
    texts = [f"the of {t} and to from here" for t in terms]
    wrong = [f"the of {w} and to from here" for t in terms for w in misspellings(t)]
    assert (model.score(pa.array(texts)) >= 0.3).all() and (model.score(pa.array(wrong)) >= 0.3).all()
    assert (model.score(pa.array([f'the of "the and {t} to of from" here' for t in terms])) < 0.3).all()
    p, q = model.score(pa.array(texts)), model.score(pa.array([x.replace(t, misspellings(t)[0]) for x, t in zip(texts, terms)]))
    assert (q < p).all()


def test_toxicity_held_out(spark):
    labels = common.table(spark, SF, "labels")
    got = queries.op10_toxicity(spark, SF)
    assert got.count() == common.table(spark, SF, "documents").count()
    out = got.join(labels.filter("toxic is not null"), "doc_id").collect()
    assert accuracy([r for r in out if r.held_out], "toxic") > 0.9
    assert np.mean([r.predicted for r in out if r.toxic == 0]) < 0.02
    assert np.mean([r.predicted for r in out if r.held_out and r.toxic == 1]) >= 0.9
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.3) for r in out)


def test_toxicity_through_its_method_on_more_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, big, "documents"), common.table(spark, big, "labels")
    model = toxicity.fit(quality.labelled(docs, labels, "toxic", toxicity.TRAINING_ROWS, langid.remainder(4) != 2))
    check_misspelled_and_quoted(model)
    out = toxicity.score(docs, model).withColumn("held_out", langid.remainder(4) == 2).join(labels.filter("toxic is not null"), "doc_id").collect()
    assert np.mean([r.predicted for r in out if r.held_out and r.toxic == 1]) >= 0.9
    assert np.mean([r.predicted for r in out if r.toxic == 0]) < 0.01
    small = common.table(spark, SF, "documents")
    check_misspelled_and_quoted(toxicity.fit(quality.labelled(small, common.table(spark, SF, "labels"), "toxic", toxicity.TRAINING_ROWS, langid.remainder(4) != 2)))
