"""Samples by counts, vectors asked for once, spans that find their lines."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval, review, verses
from folioscope.sources import io


@pytest.mark.parametrize("cells", [(64, 1 << 16), (1, 3)])
def test_sampled_keys_are_the_smallest(spark, monkeypatch, cells):
    """Equal to sorting each stratum, with cells that hold many rows too."""
    monkeypatch.setattr(review, "COARSE", cells[0])
    monkeypatch.setattr(review, "FINE", cells[1])
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 3.0])) for k in range(700)] + [(900, "c", 1.0)]
    df = spark.createDataFrame(rows, "id long, s string, w double")
    got = {(r.s, r.id) for r in review.sample_strata(df, "id", "s", {"a": 0.13, "b": 0.5}, F.col("w")).collect()}
    key = lambda i, w: -math.log((((i + 1) * 2654435761) % 2**32 + 1) / (2**32 + 1)) / w
    want = set()
    for s, rate in (("a", 0.13), ("b", 0.5), ("c", 0.0)):
        own = sorted((key(i, w), i) for i, t, w in rows if t == s)
        want |= {(s, i) for _, i in own[: max(1, int(len(own) * rate))]}
    assert got == want
    assert review.sample_strata(df.where("false"), "id", "s", {"a": 0.5}, F.col("w")).count() == 0


def test_each_text_is_embedded_once(spark, tmp_path):
    """Over all tasks and two runs; a failing run keeps what was there; null texts have no vector."""
    calls, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    os.mkdir(calls)

    def embed(texts, broken=False):
        import uuid

        if broken and "t5" in texts:
            raise ValueError("no answer")
        assert len(texts) <= 3
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(t[1:]), 1.0] for t in texts]

    asked = lambda: sorted(t for n in os.listdir(calls) for t in open(f"{calls}/{n}").read().split("\n"))  # noqa: E731, SIM115
    rows = [(k, f"t{k % 5}" if k else None) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = {r.id: r.vec for r in retrieval.embedded(df, embed, cache, size=3).collect()}
    assert got[0] is None and all(got[k] == [float(k % 5), 1.0] for k in range(1, 150)) and asked() == [f"t{k}" for k in range(5)]
    more = spark.createDataFrame([*rows, (200, "t5"), (201, "t5")], "id long, text string").repartition(4)
    with pytest.raises(Exception, match="no answer"):
        retrieval.embedded(more, lambda t: embed(t, broken=True), cache, size=3).collect()
    assert io.read_version(spark, cache, "hash string, vec array<double>").count() == 5
    got = {r.id: r.vec for r in retrieval.embedded(more, embed, cache, size=3).collect()}
    assert got[200] == got[201] == [5.0, 1.0] and asked() == [f"t{k}" for k in range(6)]


@pytest.mark.parametrize("places", [256, 2])
def test_other_spelling(spark, monkeypatch, places):
    """A difference that the lines' other spelling has is none, over several lines and bins; no pairs of all rows."""
    monkeypatch.setattr(verses, "PLACES", places)
    rng = random.Random(6)
    lines = [(b, n, [f"w{rng.randint(0, 60)}x{b}" for _ in range(rng.randint(3, 7))]) for b in (1, 2) for n in range(12)]
    spelt = [(b, n, [w + "s" if k % 4 == 1 else w for k, w in enumerate(ws)]) for b, n, ws in lines]
    quotes = []
    for k in range(40):
        a = rng.randrange(len(lines) - 2)
        own = [w for _, _, ws in (spelt if k % 2 else lines)[a : a + rng.choice([1, 2])] for w in ws]
        quotes.append((k, own))
    line = "book int, no int, words array<string>"
    ref = verses.reference_stream(spark.createDataFrame(lines, line)).cache()
    q = spark.createDataFrame(quotes, "qid int, words array<string>")
    other = spark.createDataFrame(spelt, line)
    found = verses.verify(q, ref, other)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    plain = {r.qid: r for r in verses.verify(q, ref).collect()}
    got = {r.qid: r for r in found.collect()}
    assert got.keys() == plain.keys() and len(got) > 30
    order = [(b, n) for b, n, _ in lines]
    flat = [(b, n) for b, n, ws in lines for _ in ws]
    for qid, r in plain.items():
        first, last = order.index(flat[r["from"]]), order.index(flat[r["to"] - 1])
        hay = " ".join(w for _, _, ws in spelt[first : last + 1] for w in ws)
        same = len(r.ops) > 0 and f" {' '.join(quotes[qid][1])} " in f" {hay} "
        assert (len(got[qid].ops) == 0) == (same or len(r.ops) == 0), qid
        assert got[qid].status == ("exact" if same else r.status)
    assert any(len(plain[k].ops) > 0 and len(got[k].ops) == 0 for k in got)
