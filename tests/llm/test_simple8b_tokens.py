import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, simple8b, token_output, tokens

TEXTS = ["", "a", "Hello, world!", "don't  stop\n\nnow \n", "  lead", "tail  ", "naïve café ÷ × ł 日本  x", "<|endoftext|> x", "1234abc!?", "x " * 3000]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.just(0), max_size=700), st.sampled_from([1, 7, 64, 256]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, blocks, raw = simple8b.pack(v, block)
    assert simple8b.unpack(words, raw).tolist() == values
    for b in range(len(blocks) - 1):
        assert simple8b.unpack_block(words, blocks, raw, b).tolist() == values[b * block: (b + 1) * block]


def test_simple8b_packs_densely():
    words, _, raw = simple8b.pack(np.zeros(240, np.uint64), 240)
    assert len(words) == 2 and len(raw) == 0
    assert len(simple8b.pack(np.full(60, 1, np.uint64))[0]) == 1
    assert len(simple8b.pack(np.array([2**60 - 1, 2**60], np.uint64))[2]) == 1


def test_segment_round_trip():
    ids = np.arange(1000, dtype=np.uint32)
    x = token_output.from_payload(token_output.to_payload([5, None, 7], [10, 0, 990], ids))
    assert x["ids"].tolist() == ids.tolist() and x["lengths"].tolist() == [10, 0, 990] and x["doc_null"].tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_output.from_payload(b"xxxx" + bytes(60))


PLAIN = Tokenizer.from_file(tokens.default_path())


def whole(encoder, texts):
    """The library itself, called as the contract says."""
    return [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_are_the_librarys_ids():
    rnd = random.Random(3)
    alphabet = ["a", "B", "ß", "ł", "7", ",", ".", "-", " ", " ", "\n", "\t", "'", "'s", "é", "÷", "日", "　", "\x1c", "\x85", "  ", "\n\n", "<|endoftext|>", "don't"]
    texts = TEXTS + [None] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(20_000)]
    e = tokens.Encoder(tokens.default_path(), cache=5_000)  # small: it starts anew now and then
    for at in range(0, len(texts), 3_000):
        some = texts[at: at + 3_000]
        ids, off = e.encode(pa.array(some, pa.string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [x + [0] for x in whole(e, some)]


def rows(spark, more=()):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (50, None), (50, "twice"), (50, "twice"), *more]
    return spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, start string, length int"), data


def test_files_hold_all_ids_in_order(spark, tmpdir_path):
    docs, data = rows(spark)
    token_output.write(docs, f"{tmpdir_path}/t", segment=500, partitions=3)
    got = sorted(map(tuple, token_output.documents(spark, f"{tmpdir_path}/t").collect()), key=lambda r: r[1])
    e = tokens.Encoder(tokens.default_path())
    assert [r[0] for r in got][0] is None and [r[0] for r in got][1:] == sorted(d for d, _ in data if d is not None)
    at = 0
    want = {}
    for (d, t), ids in zip(data, whole(e, [t for _, t in data])):
        ids = np.array([*ids, 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n
    assert at == sum(n for x in want.values() for n, _ in x)


def test_empty_table_of_tokens(spark, tmpdir_path):
    docs = rows(spark)[0].limit(0)
    token_output.write(docs, f"{tmpdir_path}/e")
    assert token_output.documents(spark, f"{tmpdir_path}/e").count() == 0
    assert packing.pack(docs).count() == 0


def test_added_tokens_in_texts():
    texts = ["<|endoftext|>", "abc<|endoftext|>", "a <|endoftext|>\n\n b<|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext |>", "x<|<|endoftext|>|>", None, "", " <|endoftext|> ", "don't<|endoftext|>'s"]
    e = tokens.Encoder(tokens.default_path())
    assert e.parting and e.added == {"<|endoftext|>": 50256}
    for end in (None, 0):
        ids, off = e.encode(pa.array(texts, pa.string()), end)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [x + ([0] if end is not None else []) for x in whole(e, texts)]
    e.parting = False
    ids, off = e.encode(pa.array(texts, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [x + [0] for x in whole(e, texts)]


def packed(lengths, capacity=1024):
    bins, docs = packing.Bins(capacity, 0), []
    for i, n in enumerate(lengths):
        docs.append(np.random.default_rng(i).integers(0, 50_000, n).astype("<u4"))
        bins.add(i, docs[-1])
    bins.finish()
    return bins.out, docs


def check_packed(out, docs, capacity):
    by_doc, by_sequence = {}, {}
    for d, start, n, crc, total, seq, off in out:
        assert n > 0 and total == len(docs[d]) and crc == zlib.crc32(docs[d][start: start + n].tobytes())
        by_doc.setdefault(d, []).append((start, n))
        by_sequence.setdefault(seq, []).append((off, n))
    for rows_, want in [(by_doc[i], len(x)) for i, x in enumerate(docs)]:
        at = 0
        for start, n in sorted(rows_):
            assert start == at
            at += n
        assert at == want
    padding, short = 0, 0
    for rows_ in by_sequence.values():
        at = 0
        for off, n in sorted(rows_):
            assert off == at
            at += n
        assert at <= capacity
        if at & (at - 1):
            padding += capacity - at
            short += capacity - at >= max(1, capacity // packing.PADDED)
    assert short <= 1  # the bin that a task's end leaves lacking
    return padding


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40) | st.integers(1, 3000) | st.sampled_from([1, 512, 513, 1023, 1024, 1025, 2048]), max_size=120), st.sampled_from([1, 16, 1024]))
def test_bins_hold_each_id_once(lengths, capacity):
    out, docs = packed(lengths, capacity)
    check_packed(out, docs, capacity)


def test_documents_stay_whole_in_their_class():
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 1024) for _ in range(4000)]
    out, docs = packed(lengths)
    padding = check_packed(out, docs, 1024)
    pieces = [sum(1 for r in out if r[0] == i) for i in range(0)] or {}
    for r in out:
        pieces[r[0]] = pieces.get(r[0], 0) + 1
    assert padding < 0.01 * sum(lengths)
    assert np.mean([n == 1 for n in pieces.values()]) > 0.75 and np.mean(list(pieces.values())) < 1.6
    assert np.mean([r[2] < 16 for r in out]) < 0.05
    # a bin of class k has k documents of the class
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r[5], []).append(r)
    kinds = [[packing.class_of(r[2]) for r in s if r[2] == r[4]] for s in by_sequence.values()]
    full = [k for k in kinds if k and k.count(k[0]) == k[0]]
    assert len(full) > 0.9 * len(by_sequence)


def test_packing_places_each_id_once(spark):
    docs, data = rows(spark, [(100 + i, "word " * i) for i in range(0, 900, 7)])
    got = packing.pack(docs).collect()
    e = tokens.Encoder(tokens.default_path())
    ids = [np.array([*x, 0], "<u4") for x in whole(e, [t for _, t in data])]
    once = [(d, x) for (d, _), x in zip(data, ids) if d is not None and d != 50]
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, x in once:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at: at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    assert sum(r.length for r in got) == sum(map(len, ids))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    lengths = [sum(r.length for r in pieces) for pieces in by_sequence.values()]
    assert sum(1024 - n for n in lengths if n & (n - 1)) < 0.05 * sum(lengths)
