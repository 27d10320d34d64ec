"""Error rates over whole texts, against plain Python."""

import random

from pyspark.sql import functions as F

from folioscope.operators.metrics import wer as wer_of
from folioscope.plans.rule_queries import cer, wer


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rates_of_whole_texts(spark, tmp_path):
    head = " ".join(f"word{i}" for i in range(70))
    pairs = [(0, head + " one two", head + " three two four"), (1, "a b c", "a b c " + head), (2, head, head), (3, "", "x"), (4, "", ""), (5, "a", "")]
    spark.createDataFrame([(i, r) for i, r, _ in pairs], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, h) for i, _, h in pairs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def rate(r, h):
        return round(distance(r, h) / len(r), 6) if r else float(bool(h))

    assert {r.item_id: r.cer for r in cer(spark, str(tmp_path)).collect()} == {i: rate(r, h) for i, r, h in pairs}
    assert {r.item_id: r.wer for r in wer(spark, str(tmp_path)).collect()} == {i: rate(r.split(), h.split()) for i, r, h in pairs}


def test_words_of_a_very_long_text(spark):
    from folioscope.operators.metrics import word_distance

    rng = random.Random(2)
    for _ in range(60):
        a, b = (rng.choices("abcde", k=rng.randint(0, 12)) for _ in range(2))
        assert word_distance(a, b) == distance(a, b)
    long = [f"w{k}" for k in range(52_000)]
    assert word_distance(long[:200], long) == 51_800 and word_distance(long[10:40], long[:60]) == 30
    more = spark.createDataFrame([(" ".join(long[:600]), " ".join(long))], "r string, h string")
    assert round(more.select(wer_of(F.col("r"), F.col("h"))).first()[0], 4) == round(51_400 / 600, 4)
