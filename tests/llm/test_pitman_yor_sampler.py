"""op4's score against a sampler that seats one customer at a time."""

import math
import random

import numpy as np
import pyarrow as pa

from tessera.llm import common, pitman_yor
from tessera.llm.pitman_yor import CLASSES, CONCENTRATION


class Restaurant:
    """Tables of each dish; a new table is a customer of the restaurant above."""

    def __init__(self, above, d, base, rnd):
        self.above, self.d, self.base, self.rnd = above, d, base, rnd
        self.dishes, self.customers, self.tables = {}, 0, 0

    def prob(self, dish):
        up = self.above.prob(dish) if self.above else self.base
        own = self.dishes.get(dish, [])
        return (max(sum(own) - self.d * len(own), 0) + (CONCENTRATION + self.d * self.tables) * up) / (CONCENTRATION + self.customers)

    def sit(self, dish):
        own = self.dishes.setdefault(dish, [])
        up = self.above.prob(dish) if self.above else self.base
        odds = [n - self.d for n in own] + [(CONCENTRATION + self.d * self.tables) * up]
        at = self.rnd.choices(range(len(odds)), odds)[0]
        self.customers += 1
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        self.tables += 1
        if self.above:
            self.above.sit(dish)

    def leave(self, dish):
        own = self.dishes[dish]
        at = self.rnd.choices(range(len(own)), own)[0]
        own[at] -= 1
        self.customers -= 1
        if not own[at]:
            own.pop(at)
            self.tables -= 1
            if self.above:
                self.above.leave(dish)


def brute_scores(texts, training, d, words, sweeps=150, burn_in=30, seed=1):
    rnd = random.Random(seed)
    base = 1 / (words + 1)
    root = Restaurant(None, d[0], base, rnd)
    parents = [Restaurant(root, d[1], base, rnd) for _ in range(CLASSES)]
    leaves = {}

    def leaf(c):
        if c not in leaves:
            leaves[c] = Restaurant(parents[c // CLASSES], d[2], base, rnd)
        return leaves[c]

    keys, context, _ = pitman_yor.tokens(pa.array(training))
    seats = list(zip(context.tolist(), keys.tolist()))
    for c, k in seats:
        leaf(c).sit(k)
    keys, context, off = pitman_yor.tokens(pa.array(texts))
    total = np.zeros(len(keys))
    for sweep in range(sweeps):
        rnd.shuffle(seats)
        for c, k in seats:
            leaf(c).leave(k)
            leaf(c).sit(k)
        if sweep >= burn_in:
            total += [leaf(c).prob(k) for c, k in zip(context.tolist(), keys.tolist())]
    logs = np.log10(total / (sweeps - burn_in))
    return [logs[a:b].sum() for a, b in zip(off, off[1:])]


def test_score_agrees_with_a_sampler_of_single_customers(spark):
    rnd = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "ta", "el", "or", "ing")]
    after = {w: rnd.sample(vocabulary, 3) for w in vocabulary}

    def text(n):
        out = [rnd.choice(vocabulary)]
        while len(out) < n:
            out.append(rnd.choice(after[out[-1]]) if rnd.random() < 0.8 else rnd.choice(vocabulary))
        return " ".join(out)
    rows = [(i, text(rnd.randint(5, 30))) for i in range(60)] + [(100, "new words only"), (101, ""), (102, text(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = common.F.col("doc_id") >= 50
    got = {r.doc_id: r for r in pitman_yor.score(docs, held).collect()}
    training = [t for i, t in rows if i < 50]
    words = common.written(pitman_yor.word_contexts(docs.filter(~held)), "words")
    model = pitman_yor.fit(words)
    want = dict(zip([i for i, _ in rows], brute_scores([t for _, t in rows], training, model.d, model.words)))
    assert model.tokens == sum(len(t.split()) + 1 for t in training)
    # a token: within 0.05 on average and 0.12 in any text (in log10); orders of texts agree
    gaps = [abs(got[i].score - want[i]) / got[i].n_tokens for i in want]
    assert np.mean(gaps) < 0.05 and max(gaps) < 0.12, (np.mean(gaps), max(gaps))
    whole = sum(got[i].score for i in want) / sum(want.values())
    assert abs(whole - 1) < 0.02
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    # more sweeps bring it no further from the sampler's
    more = pitman_yor.fit(words, sweeps=8)
    assert len(more.kept()) == 7 and np.allclose(model.gamma()[0], more.gamma()[0], rtol=0.15)
