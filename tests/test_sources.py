"""Sources, sinks and the SQL surface."""

import gzip
import json

from pyspark.sql import functions as F

from folioscope.functions.sql_surface import matched_by, register_functions
from folioscope.sources import io
from folioscope.sources.paged import register_paged_api


def page(url):
    """A page of the API in these tests."""
    n = int(url.rsplit("=", 1)[1])
    return {"data": [{"id": n * 10 + k, "title": f"t{k}"} for k in range(3)]} if n < 4 else {"data": None}


def test_paged_api(spark):
    register_paged_api(spark)
    df = spark.read.format("paged_api").schema("id long, title string, more string").option("url", "api?page={page}").option("last", 4).option("fetch", "tests.test_sources:page").load()
    assert sorted(map(tuple, df.collect())) == [(n * 10 + k, f"t{k}", None) for n in (1, 2, 3) for k in range(3)]


def test_json_pages_and_lines(spark, tmp_path):
    doc = {"page_id": "p1", "printed": 3, "blocks": [{"order": 1, "type": "body", "text": "a"}, {"order": 2, "type": "footnote", "text": "b"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps(doc | {"page_id": "p2"}))
    rows = io.blocks(io.read_json_pages(spark, str(tmp_path)), "book")
    assert sorted((r.page_id, r.block_id, r.text) for r in rows.collect()) == [("p1", "p1-b01", "a"), ("p1", "p1-b02", "b"), ("p2", "p2-b01", "a"), ("p2", "p2-b02", "b")]
    (tmp_path / "u.jsonl").write_text('{"ts": 1.5, "stage": "s", "cached": true}\nnot json\n{"ts": 2}\n')
    assert sorted(r.ts for r in io.read_json_lines(spark, str(tmp_path / "u.jsonl")).collect()) == [1.5, 2.0]
    assert spark.range(1).select(io.without_bom(F.lit("\ufeffx"))).first()[0] == "x"
    assert io.read_binary(spark, str(tmp_path), "*.jsonl").first().content.startswith(b'{"ts"')


def test_decisions_are_merged(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = lambda *r: spark.createDataFrame(r, "k string, at int, v string")
    io.merge_decisions(spark, rows(("a", 1, "x"), ("b", 1, "y")), path, ["k"], "at")
    got = io.merge_decisions(spark, rows(("a", 2, "z"), ("b", 0, "old")), path, ["k"], "at")
    assert sorted(map(tuple, got.collect())) == [("a", 2, "z"), ("b", 1, "y")]


def test_stream_into_files(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        io.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_functions_for_sql(spark):
    register_functions(spark)
    assert spark.sql("SELECT nfkc('ﬁ ①')").first()[0] == "fi 1"
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_rows('a  b')").collect()] == [(0, "a"), (1, "b")]
    df = spark.createDataFrame([("x1",), ("y",), (None,)], "t string")
    got = matched_by(df, lambda texts: [t if t and t[-1].isdigit() else None for t in texts], F.col("t"))
    assert [r.found for r in got.collect()] == ["x1", None, None]
