import hashlib
import random
import re

import xxhash

from tessera.llm import common, exact_dedup, simhash_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ROWS = [(3, "a  b"), (1, "a\tb"), (9, None), (8, ""), (5, "a b "), (7, "a b"), (None, "a b"), (None, "only null"), (4, "x"), (4, "x"), (6, "日 本"), (2, "日\n本")]


def frame(spark, data=ROWS):
    return spark.createDataFrame([(d, t, "z", 1, 2) for d, t in data], "doc_id long, text string, digest string, n int, `row` int")


def brute(data):
    groups = {}
    for d, t in data:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in data:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    for counters in (2, 1023):
        got = exact_dedup.annotate(frame(spark), counters).collect()
        assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_heavy_hitters_are_found_exactly(spark):
    rnd = random.Random(1)
    data = [(i, "hot") for i in range(400)] + [(1000 + i, f"w{rnd.randint(0, 300)}") for i in range(700)]
    rnd.shuffle(data)
    docs = frame(spark, data).repartition(5)
    digests = docs.select("doc_id", exact_dedup.digest().alias("digest"))
    heavy = exact_dedup.frequent(digests, 15).collect()
    assert [(r.keep_id, r.group_size) for r in heavy if r.group_size > 300] == [(0, 400)]
    assert len(heavy) <= 16
    assert sorted(map(tuple, exact_dedup.annotate(docs, 15).collect()), key=str) == brute(data)
    kept = {r.doc_id for r in exact_dedup.deduplicate(docs, 15).collect()}
    assert kept == {k for _, k, *_ in brute(data)}


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    docs = frame(spark)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len({norm(t) for _, t in ROWS}) and {norm(r.text) for r in got} == {norm(t) for _, t in ROWS}
    assert {r.doc_id for r in got} == {1, 8, 5, 4, 2, None}


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert simhash_dedup.annotate(none).count() == 0 and simhash_dedup.deduplicate(none).count() == 0


def plain_fingerprint(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i: i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in ["", "A b", "One two three four ÉÀ", "x " * 20_000, "a b c a b c a b c d", "İstanbul K"]:
        assert simhash_dedup.fingerprint(t.encode()) == plain_fingerprint(t)


def test_masks_cover_every_close_pair():
    for radius in (1, 2):
        masks = [m & (2**64 - 1) for m in simhash_dedup.masks(radius)]
        for i in range(64):
            for j in range(i + 1 if radius == 1 else 64):
                flip = (1 << i) | ((1 << j) if radius == 2 else 0)
                assert any(not m & flip for m in masks)


def test_near_groups_match_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    data = [(None, base[0]), (70, None), (71, ""), (72, " \n"), (73, "A"), (74, "a")]
    for i in range(60):
        w = rnd.choice(base).split() * 8
        w[rnd.randrange(len(w))] = "z"
        data.append((200 - i, " ".join(w)))
    data += data[-3:]
    got = simhash_dedup.annotate(frame(spark, data)).collect()
    prints = [plain_fingerprint(t) for _, t in data]
    roots = components(prints, 2)
    least = {}
    for (d, _), r in zip(data, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(data, prints, roots)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = {r.doc_id for r in simhash_dedup.deduplicate(frame(spark, data)).collect()}
    assert kept == {None, *least.values()}


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(8)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:  # a crowd within few bits, and others
        x = centre
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randrange(12)
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = common.written(spark.createDataFrame([(p,) for p in signed], "fp long"), "nodes")
    for radius in (1, 2):
        want = components(prints, radius)
        for bucket in (3, 40, 10_000):
            edges = simhash_dedup.links(nodes, radius, bucket)
            assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius for r in edges.collect())
            got = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
            mine = [got.get(s, s) for s in signed]
            assert len({(a, b) for a, b in zip(want, mine)}) == len(set(want)) == len(set(mine))
