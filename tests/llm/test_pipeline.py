"""The pipeline on a small corpus, stage by stage, against plain computations."""

import random

import pytest

import corpus_pipeline as C
from folioscope.llm.common import stored

from .test_jaccard import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    rows, labels = [], []
    for k in range(240):
        w = rng.choices(words, k=rng.choice([5, 40, 120, 300]))
        toxic = k % 6 == 0
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["moron", "scumbag", "trashy"])
        elif k > 200:
            w = rows[k - 199][1].split()
            w[len(w) // 2] = "changed"
        rows.append((k, " ".join(w), "en", f"s{k % 5}" if k % 9 else None, 0))
        labels.append((k, 1, int(toxic)))
    rows += [(240, None, "en", "s1", 0), (241, "", "en", "s1", 0), (None, rows[1][1], "en", "s1", 0), (2, rows[2][1], "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = stored(C.toxicity(spark, docs, corpus), "t")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(0, 240, 6)) and len(ids) >= 195
    unique = stored(C.near_duplicates(spark, kept, corpus), "n")
    assert unique.columns == docs.columns
    rows = sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = brute([r.text for r in rows], 5, 80, 100)
    firsts = {rows[c].doc_id for k, (n, c) in want.items()}
    got = [r.doc_id for r in unique.collect()]
    assert len(got) == len(set(got)) and set(got) == firsts
    mixed = stored(C.mixing(spark, unique, corpus), "m")
    assert mixed.columns == docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and set(copies) <= set(got)
    total = sum(len((r.text or "").split()) for r in unique.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - total) <= 0.05 * total + 300
    packed = C.packing(spark, mixed, corpus).collect()
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    # Every copy of every mixed document is packed whole: its pieces follow each other from its first id on.
    ends = {}
    for r in packed:
        ends.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    for doc, n in copies.items():
        assert sum(s == 0 for s, _ in ends[doc]) == n and sorted(s for s, _ in ends[doc] if s) == sorted(e for _, e in ends[doc] if e in {s for s, _ in ends[doc] if s})
    assert set(ends) == set(copies)


def test_run(spark, corpus):
    """run() gives what its stages give one after the other."""
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, corpus), name)
    pieces = lambda df: sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(C.run(spark, corpus)) == pieces(docs)
