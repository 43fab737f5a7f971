"""MinHash near duplicates against all pairs, and what both set joins share: short slices, clashing identities."""

import random

import numpy as np
import pytest

from tests.llm.test_queries import brute_classes as five_words
from tipflow.llm import common, decontaminate, minhash, ngram_join


def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(texts):
    """(n_shingles, component_id) of each document, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def classes(df, **how):
    rows = minhash.classes(df, **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def near_copies():
    """Large groups of near copies, chains, and texts that share most but not enough."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    docs = {}
    for i in range(120):
        t = list(base)
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(120)] = rnd.choice(words)
        docs[i] = " ".join(t)
    for i in range(120, 180):  # two thirds in common: in a block at times, never linked
        docs[i] = " ".join(base[:80] + [rnd.choice(words) for _ in range(40)])
    for i in range(180, 210):  # a chain: each close to the one before
        t = docs[i - 1].split() if i > 180 else [rnd.choice(words) for _ in range(120)]
        t[rnd.randrange(len(t))] = "link"
        docs[i] = " ".join(t).upper() if i % 2 else " ".join(t)
    for i in range(210, 240):
        docs[i] = docs[rnd.randrange(30)]
    return docs | {240: None, 241: "", 242: " \n", 243: "one two", 244: "ONE two", 245: "one"}


@pytest.mark.parametrize("chunk", [16, 1024])
def test_classes_brute_force(spark, monkeypatch, chunk):
    docs = near_copies()
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert classes(df) == brute(docs)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 1 << 62, 40_000).astype(np.uint64)
    for own in (500, 1_800, 10_000):  # beside 10,000 in common
        a, b = (np.sort(np.concatenate([every[:10_000], every[x:x + own]])) for x in (10_000, 25_000))
        x, y = minhash.signatures([a, b])
        assert abs((x == y).mean() - 10_000 / (10_000 + 2 * own)) < 0.12


def test_edge_cases(nasty, empty, spark):
    rows = minhash.classes(nasty).collect()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == 15
    assert got[(1, 12)] == (1, True) and {got[(i, 12)] for i in (2, 3, None)} == {(1, False)}
    assert got[(4, 0)] == (4, True) and got[(5, 0)] == (5, True) and got[(None, 0)] == (None, True)
    assert got[(7, 1)] == (7, True) and got[(8, 1)] == (7, False)
    assert {v[0] for (k, _), v in got.items() if k in (9, 10)} == {9}
    assert minhash.classes(empty).collect() == []
    only = spark.createDataFrame([(None, "a b c d")] * 2, "doc_id long, text string")
    assert [tuple(r) for r in minhash.classes(only).collect()] == [(None, 2, None, True)] * 2
    with pytest.raises(ValueError):
        minhash.classes(nasty, num=3, den=4)


@pytest.mark.parametrize("words", [0, 2, 4])
def test_short_slices(spark, words):
    """A document of few words alone in its partition, and after one of over 1 MB."""
    short = " ".join(f"x{i}" for i in range(words))
    long = "long text of words " * 60_000
    items = spark.createDataFrame([(1, short), (2, "long text of words long text of words")], "item_id long, text string")
    for docs in ({1: short}, {1: long, 2: short, 3: short + " x9 x9 x9"}):
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
        assert classes(df) == brute(docs)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()} == five_words(docs)
        for limit in (64 << 20, 0):
            hits = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items, broadcast_bytes=limit).collect()}
            want = {(i, 1) for i, t in docs.items() if words and f" {short} " in f" {t} "}
            assert hits == want | {(1, 2) for t in [docs[1]] if t == long}


def test_sets_that_share_the_first_half_of_their_identity(spark, monkeypatch):
    halves = common.Identity.halves
    monkeypatch.setattr(common.Identity, "halves", staticmethod(lambda s: (len(s) % 3, halves(s)[1])))
    docs = near_copies()
    texts = list({i: t for i, t in docs.items() if i % 6 == 0 or i > 180}.items())
    rows = spark.createDataFrame([(i, *common.Identity.halves(np.array(sorted(hash(x) % (1 << 62) for x in shingles(t)), np.uint64)))
                                  for i, t in texts], "doc_id long, id long, check long")
    ident = common.identity(rows)
    named = common.named(rows, ident).collect()
    assert len({r.id for r in named}) == len({(r.id, r.check) for r in rows.collect()})
