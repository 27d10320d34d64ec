"""Near duplicates where an id is repeated with different texts."""

import corpus_pipeline as C


def test_rows_are_judged_one_by_one(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("b") + " more"), (4, text("c")), (4, text("c")), (5, ""), (5, ""), (None, text("d")), (None, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 99, r.text) for r in C.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(1, text("a")), (2, text("b")), (4, text("c")), (5, ""), (5, ""), (99, text("d"))])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, twin string, copies int, copy int, verdicts string, component string, mark string"


def test_stages_on_an_empty_table_and_clashing_names(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    words = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(k, words[k // 2], "en", None if k == 3 else "s", 1, 7, "t", 3, 4, "v", "c", "m") for k in range(12)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None), (20, "", "en", "s", 0, 1, "", 0, 0, "", "", "")]
    for data in ([], rows):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            got = out.collect()
            assert (not data) == (not got)
        assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(data)
    kept = C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 2, 4, 6, 8, 10, 20] and len(kept) == 8
    assert all(r.place == 7 and r.twin == "t" for r in kept if r.doc_id is not None and r.doc_id < 20)


def test_mixing_does_not_depend_on_layout(spark):
    rows = [(k % 50, " ".join(["w"] * (k % 37 + 1)) + f" {k % 80}", "en", f"s{k % 3}", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = (sorted(map(tuple, C.mixing(spark, docs.repartition(n), "").collect())) for n in (3, 7))
    assert a == b and a


ODD = "doc_id long, text string, lang string, source string, n_chars long, props map<string,string>"


def test_rows_that_differ_by_a_null_s_place(spark):
    """Mixing tells (null, 'x') from ('x', null), keeps maps, and writes no row too often."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(20 + k)), "en", "s", 1, {"a": str(k)}) for k in range(10)]
    rows += [(50, "one text of many words here", None, "x", 1, None), (50, "one text of many words here", "x", None, 1, None)]
    got = C.mixing(spark, spark.createDataFrame(rows, ODD), "").collect()
    count = {}
    for r in got:
        count[r.doc_id, r.lang, r.source] = count.get((r.doc_id, r.lang, r.source), 0) + 1
    assert max(count.values()) <= 3 and all(r.props == {"a": str(r.doc_id)} for r in got if r.doc_id < 10)
    # Three sources of weights 1, 2, 3: "x" and the null source take three copies of their row, at their cap.
    assert count[50, None, "x"] == 3 and count[50, "x", None] == 3


def test_equal_ids_and_texts_with_other_columns(spark):
    """The same row stays, however the table is split."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", f"s{k}", k) for k in range(12)] + [(2, text + " more", "en", "z", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {tuple(map(tuple, C.near_duplicates(spark, docs.repartition(n), "").collect())) for n in (1, 3, 5)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
