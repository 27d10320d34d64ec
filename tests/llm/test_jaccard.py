"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from folioscope.llm import jaccard_join as J
from folioscope.llm.components import connected_components


def brute(texts, words, num, den):
    """Shingle counts and smallest reachable ids, from sets of word tuples."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [None, "", "  ", "a", "A", "a b", "A  b", "a b c"]
    while len(texts) < n:
        if rng.random() < 0.45 or len(texts) < 20:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 6, 9, 14, 30, 80, 200, 400]))))
        else:
            w = (rng.choice(texts[8:]) or "x").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1, 1]))
                w = w or ["y"]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 2, 60, 100)])
def test_components(docs, seed, words, num, den):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs(texts), words, num, den).collect()}
    assert got == brute(texts, words, num, den)


def test_a_chain_of_near_copies(docs):
    """Neighbours link, others don't: the second superstep has to find the links."""
    base = [f"v{k}" for k in range(100)]
    texts = [" ".join([f"n{j}" for j in range(i)] + base[i:]) for i in range(0, 40)]
    random.Random(4).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs(texts), 3, 90, 100).collect()}
    assert got == brute(texts, 3, 90, 100)


@pytest.mark.parametrize(("leaves", "shingles"), [(8192, 4_000_000), (16, 4_000_000), (8, 600)])
def test_hot_nodes(docs, monkeypatch, leaves, shingles):
    """Many near copies of one text, exact copies, and a passage that many texts share; nodes in slots too."""
    monkeypatch.setattr(J, "NODE_LEAVES", leaves)
    monkeypatch.setattr(J, "FAMILY_SHINGLES", shingles)
    monkeypatch.setattr(J, "KNOWN_MEMBERS", 8)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    texts = [" ".join(base)] * 30
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([f"q{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 4, 40]))] + passage) for _ in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs(texts), 3, 90, 100).collect()}
    assert got == brute(texts, 3, 90, 100)


def test_prefixes_meet():
    """Of two linked sets, the smaller one's short prefix meets the larger one's prefix, in any order of shingles."""
    rng = np.random.default_rng(1)
    levels = rng.integers(0, 9, J.CELLS).astype(np.uint8)
    for num in (80, 90):
        for n in [*range(1, 60), 100, 333, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                b = a.copy()
                for _ in range(n):
                    c = np.append(b[rng.integers(0, 2) :], rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64))
                    rng.shuffle(c)
                    if not len(c) or not J.linked(a, np.unique(c), num, 100):
                        break
                    b = c
                b = np.unique(b)
                x, y = (a, b) if len(a) >= len(b) else (b, a)
                (p, _), (q, short) = J.prefix(x, levels, num, 100), J.prefix(y, levels, num, 100)
                assert set(p.tolist()) & set(q[:short].tolist())


def test_levels_order_by_count(docs):
    texts = ["common words here again"] * 40 + [f"only{k} once{k} here{k} x{k}" for k in range(40)]
    levels = J.shingle_levels(docs(texts).selectExpr("text"), 3)
    common, rare = J.shingle_set(texts[0], 3), J.shingle_set(texts[50], 3)
    assert levels[(common >> np.uint64(42)).astype(int)].min() > levels[(rare >> np.uint64(42)).astype(int)].max()
    assert len(J.prefix(np.sort(np.concatenate([common, rare])), levels, 80, 100)[0]) == 1


def test_nulls_repeats_and_empty_table(docs):
    texts = ["a b c d", "a b c d", "A b c D", None, None, ""]
    df = docs(texts, ids=[7, 7, None, 3, None, 1])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_components(df, 3, 90, 100).collect() if r.component_id is not None)
    assert got == [(False, 1, 0, 1), (False, 3, 0, 3), (False, 7, 2, 7), (False, 7, 2, 7), (True, 0, 2, 7)]
    assert J.jaccard_components(docs([]), 3, 90, 100).count() == 0


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 12), (12, 10), (20, 20)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3, 4, 5)} == {1} and {got[k] for k in (10, 11, 12)} == {10} and {got[100 + k] for k in range(41)} == {100}
