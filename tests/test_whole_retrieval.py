"""Searches with all questions, against plain Python."""

import math
import random
from collections import Counter

import numpy as np

from folioscope.operators import retrieval
from folioscope.plans import retrieval_queries as R


def tables(spark, at, n_items=30, n_docs=120, n_vectors=450):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))
    docs = {i: text(rng.randint(0, 60)) for i in range(n_docs)}
    items = {i: text(8) for i in range(n_items)}
    gen = np.random.default_rng(5)
    vecs = {i: gen.integers(-3, 4, 6).astype(float) for i in range(n_vectors)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(i, v.tolist(), i % 4) for i, v in vecs.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return docs, items, vecs


def top(scores, n):
    return [i for i, _ in sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:n]]


def test_every_question_and_every_hundredth_vector_asks(spark, tmp_path):
    docs, items, vecs = tables(spark, tmp_path)
    words = {i: t.split() for i, t in docs.items()}
    average = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for q, t in items.items():
        scores = {}
        for i, ws in words.items():
            tf, score = Counter(ws), 0.0
            for w in set(t.split()) & set(ws):
                raw = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                score += max(raw, 0) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) if raw > 0 else 1e-6 * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average))
            if set(t.split()) & set(ws):
                scores[i] = round(score, 6)
        want[q] = top(scores, 5)
    got = {}
    for r in R.bm25_topk(spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: ids for q, ids in want.items() if ids} and len(got) > 20

    got = {}
    for r in R.dense_topk(spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: top({i: v @ vecs[q] for i, v in vecs.items() if i != q}, 5) for q in (0, 100, 200, 300, 400)}
    assert R.ir_metrics(spark, str(tmp_path)).first().n == 5
    assert {r.qid for r in R.hybrid_rrf(spark, str(tmp_path)).collect()} == set(items)


def test_bests_of_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = np.random.default_rng(1).integers(-2, 3, (300, 4)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(7)
    queries = vectors.where("id < 11").selectExpr("id qid", "vec qvec")
    got = {}
    for r in retrieval.dense_top(queries, vectors, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: top({i: x @ v[q] for i, x in enumerate(v) if i != q}, 4) for q in range(11)}
    assert retrieval.dense_top(queries.where("false"), vectors, 4).count() == 0
