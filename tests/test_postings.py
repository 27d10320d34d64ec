"""The standing index against plain joins."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import postings, ranking, retrieval


def texts_of(rng, n):
    words = ["a", "be", "cat", "care", "cares", "caress", "doge", "dogs", "12", "7", "zeta", "the", "the"]
    return [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 30])))) for k in range(n)]


@pytest.mark.parametrize(("first", "questions"), [(1, 256), (2, 2)])
def test_searches_equal_plain_joins(spark, tmp_path, monkeypatch, first, questions):
    """Blocks are pruned, questions are dealt into groups, and the results are those of all pairs."""
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "QUESTIONS", questions)
    monkeypatch.setattr(postings, "TERMS", 3)
    monkeypatch.setattr(postings, "NAMED_TERMS", 2 if first == 1 else 1000)
    rng = random.Random(first)
    rows = texts_of(rng, 90)
    frame = spark.createDataFrame([*rows, (200, None), (None, "cat dogs")], "id long, key string")
    index = postings.write_index(frame, str(tmp_path), block_texts=7)
    asked = [(q, t) for q in range(9) for t in rng.sample(["a", "be", "care", "cat", "dogs", "doge", "the", "none", "zeta"], 3)] + [(None, "a"), (3, None), (4, "care"), (4, "care")]
    queries = spark.createDataFrame(asked, "qid long, qterm string")
    plain = spark.createDataFrame([*rows, (200, "")], "id long, key string").select("id", F.filter(F.split("key", " "), lambda w: w != "").alias("words"))
    for prefix in (True, False):
        want = ranking.ranked(retrieval.bm25(plain, queries.dropna(), prefix=prefix), 4)
        got = postings.lexical_top(index, queries, 4, prefix=prefix)
        key = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 5)) for r in df.collect())
        assert key(got) == key(want)
    assert postings.lexical_top(index, queries.where("false"), 4).count() == 0


def test_an_empty_index(spark, tmp_path):
    index = postings.write_index(spark.createDataFrame([], "id long, key string"), str(tmp_path))
    assert postings.lexical_top(index, spark.createDataFrame([(1, "word")], "qid long, qterm string"), 3).count() == 0
    assert postings.phrase_top(index, spark.createDataFrame([(1, "a b")], "qid long, phrase string")).count() == 0


def test_a_unit_with_several_windows(spark, tmp_path):
    """Windows of one unit are found as one, at the place of the best."""
    rows = [(1, "cat cat cat"), (1, "cat cat dogs"), (1, "cat"), (2, "cat dogs dogs dogs dogs"), (3, "zeta")]
    index = postings.write_index(spark.createDataFrame(rows, "id long, key string"), str(tmp_path), block_texts=2)
    got = postings.lexical_top(index, spark.createDataFrame([(0, "cat")], "qid long, qterm string"), 2, windows=3).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(1, 1), (2, 2)]


def test_phrases(spark, tmp_path):
    """Numbers are no words of a text; words must stand side by side and whole."""
    rng = random.Random(4)
    rows = texts_of(rng, 80) + [(500, "be 12 cat"), (501, "12 be ٣ 7 cat 9"), (502, "be cats"), (503, "cat be")]
    index = postings.write_index(spark.createDataFrame(rows, "id long, key string"), str(tmp_path), block_texts=9)
    phrases = ["be cat", "the the", "care dogs the", "12 be", "none be", "a a a"]
    got = {}
    for r in postings.phrase_top(index, spark.createDataFrame([*enumerate(phrases), (9, None)], "qid long, phrase string"), 1000).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = {}
    for q, p in enumerate(phrases):
        hits = [i for i, t in rows if f" {p} " in " " + " ".join(re.sub(r"\b\d+\b", " ", t).split()) + " "]
        if hits:
            want[q] = hits
    assert got == want and {500, 501} <= set(want[0])


def test_vectors_of_two_lengths_and_nulls(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, None), (None, [9.0, 9.0]), (5, [3.0, 0.0, 0.0]), (2, [5.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (7, None)], "qid long, qvec array<double>")
    assert sorted((r.qid, r["rank"], r.id, r.score) for r in retrieval.dense_top(q, v, 3).collect()) == [(1, 1, 2, 5.0), (3, 1, 5, 3.0)]


def test_numbers_take_as_many_bytes_as_they_need():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 6, 40)
    cut = np.cumsum(n) - n
    parts = np.concatenate([rng.integers(0, high, k) for k, high in zip(n, np.resize([2, 256, 257, 65536, 65537, 2**32], 40), strict=True)]).astype(np.int64)
    column = postings._narrow(parts, cut)
    assert postings._widened(column, n).tolist() == parts.tolist()
    assert [len(c) for c in column.to_pylist()] == [k * (1 if top < 256 else 2 if top < 65536 else 4) for k, top in zip(n, np.maximum.reduceat(parts, cut), strict=True)]
    assert len(postings._narrow(parts[:0], cut[:0])) == 0 and len(postings._widened(column.slice(0, 0), n[:0])) == 0


def test_the_index_moves_no_text_and_phrases_need_no_dictionary(spark, tmp_path, monkeypatch):
    """Blocks are texts that lie together, whole but for each part's last; the dictionary waits for a search that expands terms."""
    seen, real = {}, postings.scratch
    monkeypatch.setattr(postings, "scratch", lambda df, label: (seen.update({label: df._jdf.queryExecution().executedPlan().toString()}), real(df, label))[1])
    rows = [(k, f"word{k % 5} and other{k % 3}") for k in range(400)]
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a part for each file
    index = postings.write_index(spark.createDataFrame(rows, "id long, key string").repartition(9), str(tmp_path), block_texts=7)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange" not in seen["inverted"]
    sizes = [len(r.ids) // 8 for r in index.blocks.collect()]
    assert sum(sizes) == 400 and max(sizes) == 7 and index.blocks.select("block").distinct().count() == len(sizes) <= 400 // 7 + 9
    got = postings.phrase_top(index, spark.createDataFrame([(1, "word2 and other1")], "qid long, phrase string"))
    assert [r.id for r in got.orderBy("rank").collect()] == [k for k in range(400) if k % 5 == 2 and k % 3 == 1][:10]
    assert not (tmp_path / "terms").exists() and index.terms.count() == 9 and (tmp_path / "terms").exists()
