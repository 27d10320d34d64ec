"""Top-k search against all products; licenses against every window; the chain on held-out rows."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import licenses, topk_search, toxicity
from folioscope.llm.tokens import Memo

VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k):
    out = {}
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {(q, tuple(v)) for q, v in good if q % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_topk(spark, dim, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = random.Random(dim)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.25]) for _ in range(dim)]) for i in range(1, 402)]
    rows += [(500 + i, list(rows[7][1])) for i in range(20)]  # ties
    rows += [(1000, None), (1050, []), (1100, [None] * dim), (1150, [float("nan")] * dim), (1200, [float("inf")] * dim), (None, [0.1] * dim), (1250, [0.5] * (dim + 1)), (1301, [0.5] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    got = {}
    for r in topk_search.top_k(topk_search.integer_vectors(df), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: [(k + 1, i, s) for k, (i, s) in enumerate(v)] for q, v in brute(rows, 5).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_topk_of_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [1.0, 0.0], "", "")], VECTORS)
    assert [tuple(r) for r in topk_search.top_k(topk_search.integer_vectors(one), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 65536)]
    assert topk_search.top_k(topk_search.integer_vectors(one.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_integers_are_packed_narrow_and_whole():
    for high in (5, 1 << 15, 1 << 31, 1 << 50):
        x = np.array([[high - 1, -high], [0, 3]], np.int64)
        blob = topk_search.narrow(x)
        assert (topk_search.wide(blob, 2) == x).all() and len(blob) == 1 + 4 * {5: 2, 1 << 15: 2, 1 << 31: 4, 1 << 50: 8}[high]


def test_repeated_queries_and_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], VECTORS)
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk_search.top_k(topk_search.integer_vectors(df), F.col("vec_id") % 50 == 0).collect())
    # Two different vectors ask under one id; no row of that id is a candidate.
    assert got == [(1, 1, 65536), (2, 1, 65536), (3, 2, 65536), (4, 1, 0), (5, 1, 0)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-90, 90, (5, 64)).astype(float), rng.integers(-90, 90, (300, 64)).astype(float)
    for s in (1, 3, 4, 16, 63):
        assert (topk_search.segment_statistics(q, s) @ topk_search.segment_statistics(x, s).T >= q @ x.T - 1e-6).all()


def license_texts(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "license", "Licensed under the Apache License, Version 2.0"]
    for k in range(60):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.choice([3, 40, 400, 3000]))]
        for _ in range(rng.choice([0, 1, 2])):
            t = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][2].split()
            for _ in range(rng.choice([0, 0, len(t) // 40, len(t) // 12])):
                t[rng.randrange(len(t))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(" ".join(words))
    return texts


def test_licenses_against_every_window():
    """All windows are compared with all templates; banding must not lose any match."""
    s = licenses.Scanner()
    memo = Memo(xxhash.xxh3_64_intdigest)
    found = 0
    for text in license_texts():
        h = licenses.shingles(licenses.words_of(text), memo)
        want = {}
        for longest, size, _, table in s.groups:
            members = {k for ks in table.values() for k in ks}
            for start in range(0, max(len(h), 1), longest):
                own = h[start : start + size]
                for k in members:
                    share = np.isin(s.sets[k], own).mean() if len(own) else 0
                    if share >= s.containment:
                        want[k] = max(want.get(k, 0), share)
        got = {name: c for name, _, c, _, _ in s.scan(text)}
        assert got == pytest.approx({s.names[k][0]: c for k, c in want.items()})
        found += len(got)
    assert found > 20


def test_license_rows(docs):
    df = docs(["x y. Released under the MIT License. z", None, "", "Released under the MIT License"], ids=[1, 2, 3, None])
    got = sorted((r.doc_id or 0, r.template, r.license, r.containment, r.first_word, r.last_word) for r in licenses.scan_licenses(df).collect())
    assert got == [(0, "mit-notice", "MIT", 1.0, 0, 4), (1, "mit-notice", "MIT", 1.0, 2, 6)]
    assert licenses.scan_licenses(docs([])).count() == 0


def test_bands_guarantee_retrieval():
    for s in (0.1, 0.3, 0.9):
        b = licenses.bands_for(s)
        assert 1 - (1 - s**licenses.ROWS) ** b >= licenses.RETRIEVED > 1 - (1 - s**licenses.ROWS) ** (b - 1)


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_chain_on_held_out_documents(spark, labelled):
    documents, labels = labelled
    marks = toxicity.category_labels(labels)
    fit, held = marks.where("doc_id % 2 = 0"), marks.where("doc_id % 2 = 1")
    chain = toxicity.fit_chain(documents, fit, list(toxicity.CATEGORIES))
    rows = toxicity.classify(documents, chain).select("doc_id", F.col("toxic").alias("said"), F.col("low_quality").alias("low")).join(held, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.said for r in toxic) / len(toxic) >= 0.9
    assert sum(r.said for r in clean) / len(clean) <= 0.01
    low = [r for r in rows if r.low_quality == 1]
    assert sum(r.low for r in low) / len(low) >= 0.6


def test_chain_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(None, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    texts = [f"nice day number {k}" if k % 2 == 0 else f"you awful fool {k}" for k in range(40)] + [None, ""]
    df = docs(texts)
    chain = toxicity.fit_chain(df, toxicity.category_labels(labels), ["low_quality", "toxic"])
    got = {r.doc_id: r.toxic for r in toxicity.classify(df, chain).collect()}
    assert all(got[k] == (k % 2 == 1) for k in range(40)) and len(got) == 42
    none = toxicity.fit_chain(df.limit(0), toxicity.category_labels(labels).limit(0), ["low_quality", "toxic"])
    assert toxicity.classify(df, none).where("toxic").count() == 0
    kept = toxicity.classify(df, chain, keep=True)
    assert kept.columns == [*df.columns, "verdicts"]


def test_templates_of_any_length(docs):
    """Templates without words are passed over; one of 1,500 words is found whole, and not in half of it."""
    long = " ".join(f"clause{k}" for k in range(1500))
    templates = (("none", "X", " .,; "), ("long", "L", long), ("short", "S", "a few words only"))
    half = " ".join(long.split()[:700])
    rows = licenses.scan_licenses(docs([f"before {long} after", half, None, "", f"x {half} a few words only"]), templates).collect()
    assert sorted((r.doc_id, r.template, r.containment) for r in rows) == [(0, "long", 1.0), (4, "short", 1.0)]
    assert licenses.scan_licenses(docs(["a"]), (("none", "X", ""),)).count() == 0
