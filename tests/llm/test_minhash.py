"""MinHash deduplication against all pairs."""

import random

import numpy as np
import pytest

from folioscope.llm import minhash_dedup as M
from folioscope.llm.jaccard_join import shingle_set

from .test_jaccard import brute, corpus


def check(docs, texts, words, num, den, **kw):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.minhash_components(docs(texts, **kw), words, num, den).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute(texts, words, num, den).items()}


@pytest.mark.parametrize(("seed", "words", "num"), [(1, 3, 85), (2, 5, 80)])
def test_components(docs, seed, words, num):
    check(docs, corpus(seed), words, num, 100)


@pytest.mark.parametrize(("leaves", "shingles"), [(8192, 4_000_000), (16, 2000)])
def test_hot_buckets(docs, monkeypatch, leaves, shingles):
    """A chain of near copies, near copies of one text, exact copies and a passage that many texts share; in slots too."""
    monkeypatch.setattr(M, "NODE_LEAVES", leaves)
    monkeypatch.setattr(M, "FAMILY_SHINGLES", shingles)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    texts = [" ".join(base)] * 30
    texts += [" ".join([f"n{j}" for j in range(i)] + base[i:]) for i in range(0, 40, 2)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:90] + [f"x{k}y{j}" for j in range(rng.choice([5, 20, 60]))]) for k in range(60)]
    rng.shuffle(texts)
    check(docs, texts, 3, 85, 100)


def test_odd_tables(docs, spark):
    assert M.minhash_components(docs([])).count() == 0
    texts = ["a b c d e f", "a b c d e f", None, "", "z y x w v", "a b c d e f"]
    rows = M.minhash_components(docs(texts, ids=[3, 3, None, None, None, 1]), 3, 85, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == sorted([("3", 4, "1", False)] * 2 + [("None", 0, "None", True)] * 2 + [("None", 3, "None", True), ("1", 4, "1", True)])
    long = " ".join(f"w{k % 5003}" for k in range(60_000))
    got = M.minhash_components(docs([long, long + " end", "other words here"]), 3, 85, 100).collect()
    assert sorted(r.component_id for r in got) == [0, 0, 2]


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    a = [f"a{k}" for k in range(400)]
    for share in (0.3, 0.6, 0.9):
        b = [w if rng.random() < share else f"b{k}" for k, w in enumerate(a)]
        s, t = shingle_set(" ".join(a), 1), shingle_set(" ".join(b), 1)
        j = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        assert abs((M.minima(s) == M.minima(t)).mean() - j) < 0.13
    assert (1 - 0.85**M.ROWS) ** M.BANDS < 1e-10 and M.least_matches(85, 100) < 0.85 * M.HASHES


def test_filter_of_texts_at_its_largest(docs, monkeypatch):
    """A filter that is too small lets texts through and changes nothing else."""
    from folioscope.llm import jaccard_join as J

    monkeypatch.setattr(J, "LEAST_BITS", 8)
    monkeypatch.setattr(J, "MOST_BITS", 8)
    check(docs, corpus(4, 120), 3, 85, 100)
