"""op4's contexts are words: what follows a word counts, not what follows its ending."""

import random

import pytest

from tessera.llm import common, pitman_yor


def _docs(spark):
    rnd = random.Random(3)
    words = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("n", "at", "el", "ing")]
    pairs = [("fat", "dog"), ("cat", "fish"), ("boat", "tree")]  # the words before end alike
    rows = [(i, " ".join(f"{a} {b} {rnd.choice(words)}" for a, b in rnd.sample(pairs, 3))) for i in range(60)]
    rows += [(100, "fat dog"), (101, "fat fish"), (102, "cat fish"), (103, "cat dog"), (104, "unheard fish"), (105, "fat unheard"), (106, None), (107, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _scores(spark):
    return {r.doc_id: r for r in pitman_yor.score(_docs(spark), common.F.col("doc_id") >= 100).collect()}


def test_pairs_of_words_count(spark):
    """"fat" and "cat" end alike, and "dog" and "fish" occur as often; what tells the texts apart are the pairs."""
    got = _scores(spark)
    for seen, other in ((100, 101), (102, 103)):
        assert got[seen].base_score == pytest.approx(got[other].base_score)
        assert got[seen].score > got[other].score + 0.3
    assert got[105].n_known == 2 and got[104].n_known == 2 and got[106].n_tokens == got[107].n_tokens == 1
    assert got[106].score == pytest.approx(got[107].score)


def test_what_is_broadcast_changes_no_score(spark, monkeypatch):
    """frequent pairs, words and contexts are scored early, to the same end."""
    want = _scores(spark)
    monkeypatch.setattr(pitman_yor, "FREQUENT", 0)
    monkeypatch.setattr(pitman_yor, "FREQUENT_PAIRS", 0)
    got = _scores(spark)
    assert all(got[i].score == pytest.approx(want[i].score, rel=1e-5) and got[i].n_known == want[i].n_known and got[i].base_score == pytest.approx(want[i].base_score) for i in want)


def test_contexts_near_or_joined_are_the_same(spark, monkeypatch):
    """totals of contexts that are too many to be broadcast come with the words."""
    words = common.written(pitman_yor.word_contexts(_docs(spark).filter("doc_id < 100")), "words")

    def leaves(model):
        out = {}
        for batch in model.beside(words).select("key", "contexts", "n", "own").toArrow().combine_chunks().to_batches():
            seats, _ = pitman_yor._seated(batch)
            first = [*seats.heads[0], len(seats.place[2])]
            for k, a, b in zip(batch.column(0).to_pylist(), first, first[1:]):
                out[k] = [(x.customers[a:b].tolist(), x.tables[a:b].tolist()) for x in model.leaves(seats, batch.column(3))]
        return out

    model = pitman_yor.fit(words)
    want = leaves(model)
    assert model.near is not None and all(len(x) == 4 for x in want.values())
    model.near = None
    assert leaves(model) == want
    near = _scores(spark)
    monkeypatch.setattr(pitman_yor, "LEAF_BYTES", 0)
    assert pitman_yor.fit(words).near is None
    far = _scores(spark)  # other batches, so other draws
    gaps = [abs(far[i].score - near[i].score) / near[i].n_tokens for i in near]
    assert sum(gaps) / len(gaps) < 0.05 and max(gaps) < 0.3 and all(far[i].n_known == near[i].n_known for i in near)


def test_long_rows_of_a_word_are_gathered_whole(spark):
    """a word has as many contexts as there are words before it, over many batches."""
    text = " ".join(f"w{i} the" for i in range(5000)) + " the the"
    words = pitman_yor.word_contexts(spark.createDataFrame([(text,), (text,)], "text string")).collect()
    most = max(words, key=lambda r: r.c)
    assert most.c == 2 * 5002 and len(words) == 5002 and len(most.contexts) == len(set(most.contexts)) >= 4950 and most.contexts == sorted(most.contexts)
    assert sum(most.n) == most.c and max(most.n) <= 8  # some of so many words share a number
