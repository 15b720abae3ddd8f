import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import veska.llm.packing as pk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.just(32))
def test_bins_never_overflow(sizes, capacity):
    s = np.array(sizes, np.int64)
    if not len(s):
        return
    b = pk.pack(s, capacity)
    load = np.bincount(b, weights=s)
    assert len(b) == len(s) and load.max() <= capacity and (load > 0).all()
    assert len(load) <= 2 * -(-s.sum() // capacity) + 1


def test_little_room_is_lost():
    rng = np.random.default_rng(0)
    for capacity in (512, 2048):
        s = np.minimum(rng.lognormal(5.3, 1.0, 5000).astype(int) + 1, capacity)
        bins = pk.pack(s, capacity).max() + 1
        assert bins <= 1.002 * -(-s.sum() // capacity) + 1


def test_each_placement_is_the_best():
    """Every item goes where the sum of squared counts is least among the bins with room."""
    rng = np.random.default_rng(1)
    s, cap = rng.integers(1, 20, 200), 20
    bins = pk.sum_of_squares(s, cap)
    load: dict = {}
    for k in np.argsort(-s, kind="stable"):
        gaps = [cap - x for x in load.values()]
        cost = lambda g: sum(np.bincount([x for x in g if x], minlength=1) ** 2) if any(g) else 0
        options = {g: cost([*[x for i, x in enumerate(gaps) if i != gaps.index(g)], g - s[k]]) for g in set(gaps) if g >= s[k]}
        if options:
            assert cap - load.get(bins[k], 0) in [g for g, c in options.items() if c == min(options.values())]
        else:
            assert bins[k] not in load
        load[bins[k]] = load.get(bins[k], 0) + s[k]


def test_counts_equal_the_tokenizer():
    c = pk.Counter(pk.VOCABULARY)
    rnd = random.Random(0)
    texts = ["", " ", "a", "Привет,  мир!\n\n it's 10 000 ½ … \t x ", "a b c 　d", "\x1c x\x1fy", "don't  stop", "\r\n\r\n a"]
    texts += ["".join(rnd.choice("ab ,.1é ж\n\t 'sI") for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert c.count(t) == len(c.encode(t)), repr(t)


SCHEMA = "doc_id bigint, text string, bin string, tokens int"


@pytest.mark.parametrize("block", [40, 50_000])
def test_documents(spark, monkeypatch, block):
    rnd = random.Random(1)
    texts = [None, "", "   ", "word " * 3000] + [" ".join("w%d" % rnd.randrange(50) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, "a b", "x", 1)]
    monkeypatch.setattr(pk, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA)
    got = pk.pack_documents(df, "doc_id", "text", 128).collect()
    load: dict = {}
    for r in got:
        if r.bin is not None:
            load[r.bin] = load.get(r.bin, 0) + r.tokens
    count = pk.Counter(pk.VOCABULARY).count
    assert sum(load.values()) == sum(count(t or "") for _, t, _, _ in rows) and max(load.values()) <= 128
    assert sorted(r.doc_id for r in got if r.bin is None) == [0, 1]
    assert len(load) <= 1.06 * -(-sum(load.values()) // 128) + 1
    pieces = sorted((r.token_from, r.tokens) for r in got if r.doc_id == 3)
    assert [p[0] for p in pieces] == list(range(0, count(texts[3]), 128)) and all(n == 128 for _, n in pieces[:-1])
    assert sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert pk.pack_documents(df.limit(0), "doc_id", "text", 128).count() == 0


def test_bins_without_room_for_the_smallest_are_done(spark, monkeypatch):
    """Pieces of a third to 0.6 of the capacity: hardly a bin fills, yet the rounds end, and
    the number of bins stays near that of one block."""
    rng = np.random.default_rng(4)
    words = rng.integers(34, 60, 3000)
    rows = [(i, "a " * int(n)) for i, n in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    whole = pk.pack_documents(docs, "doc_id", "text", 120).select("bin").distinct().count()
    monkeypatch.setattr(pk, "BLOCK", 300)
    assert pk.pack_documents(docs, "doc_id", "text", 120).select("bin").distinct().count() <= 1.02 * whole
