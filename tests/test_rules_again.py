"""Rules against cases written from what they say."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import tokens as T
from folioscope.operators import alignment, chunking, gates, review
from folioscope.sources import io


def ev(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_search_phrase_drops_free_numbers(spark):
    phrase = lambda t: ev(spark, T.search_phrase(F.lit(t)))
    assert phrase("الرجل 5, الى البيت الكبير") == "الرجل الى البيت الكبير"
    assert phrase("الرجل ٥ الى البيت (12) الكبير ٤٤.") == "الرجل الى البيت الكبير"
    assert phrase("الرجل x5 الى 3-4 البيت") == "الرجل x5 الى البيت"
    assert phrase("الرجل ٦¹ الى البيت a_b") == "الرجل ٦ الى البيت a_b"


VOTES = [
    ("كتب", "كَتب", "كَتب", 90.0, False, "agree"),
    ("قلم", "كَتب", "كَتب", 90.0, True, "agree"),
    ("كتب", "كَتب", "كتب", 90.0, False, "abstain"),
    ("قلم", "كَتب", "كَتب", 50.0, False, "abstain_a"),
    (None, "كَتب", "كَتب", None, False, "abstain_a"),
    ("قلم", "كَتب", "كَتب", 60.0, False, "disputed"),
    ("قلم", "كَتب", "كتب", 10.0, False, "disputed"),
    ("كتب", "كَتب", "كُتب", 90.0, False, "disputed"),
    ("كتب", "كتب", "كَتب", 90.0, False, "disputed"),
    ("كتب", "كتب", None, 90.0, False, "disputed"),
    ("كتب", "كتب", "قلم", 90.0, False, "disputed"),
    ("،", "،", "،", 90.0, False, "agree"),
]


def test_three_readers(spark):
    df = spark.createDataFrame([(k, *v[:5]) for k, v in enumerate(VOTES)], "k int, a string, b string, c string, conf double, furniture boolean")
    got = df.select("k", review.vote3(F.col("a"), F.col("b"), F.col("c"), F.col("conf"), F.col("furniture")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [v[-1] for v in VOTES]


def test_words_match_by_edit_distance(spark):
    df = spark.createDataFrame([(["x", "abcd", "y", "abcde"], ["x", "dabc", "y", "abcdx"])], "a array<string>, b array<string>")
    got = df.select(alignment.matched_words(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(m.at, m.other, m.exact) for m in got] == [(0, 0, True), (2, 2, True), (3, 3, False)]


def test_edit_distances():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    import random

    rng = random.Random(5)
    for _ in range(600):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert alignment.edit_distance(a, b) == plain(a, b), (a, b)


def test_tokens_take_the_most_similar_open_word(spark):
    df = spark.createDataFrame([(["one", "abcd", "abce", "end", "zz"], ["one", "abxe", "abcx", "end", "yy"])], "a array<string>, b array<string>")
    got = df.select(alignment.token_places(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(m.at, m.other, m.exact) for m in got] == [(0, 0, False), (1, 2, False), (2, 1, False), (3, 3, False)]


def test_a_term_of_any_characters(spark):
    r"""A term's label may hold \E and other marks of patterns."""
    items = spark.createDataFrame([("T1", "term", r"a\E.*", "the first meaning", None), ("T2", "note", None, r"x\E: other words", None)], "tag string, kind string, term string, words string, note string")
    quotes = spark.createDataFrame([(1, "T1", r" a\E.* : first meaning"), (2, "T1", "b: first meaning"), (3, "T1", "first meaning"), (4, "T2", "other words"), (5, "T9", "first meaning")], "qid int, tag string, quote string")
    assert {r.qid: r.kept for r in gates.verify_external(quotes, items).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_texts_without_an_order_come_last(spark):
    df = spark.createDataFrame([("a", None, "zz"), ("a", 2, "bb"), ("a", 1, "aa"), ("a", None, "yy"), ("a", 5, None)], "g string, o int, t string")
    got = chunking.fixed_chunks(df, "g", "o", "t", size=100, overlap=10).collect()
    assert [(r.text, r["first"]) for r in got] == [("aa bb  yy zz ", 1)]


def test_a_merge_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    rows = lambda *r: spark.createDataFrame(r, "k string, at int, v string")
    read = lambda: sorted(map(tuple, io.read_version(spark, path, "k string, at int, v string").collect()))
    assert read() == []
    io.merge_decisions(spark, rows(("a", 1, "x")), path, ["k"], "at")
    held = io.read_version(spark, path, "k string, at int, v string")

    real = io._folder

    def broken(session, where):
        fs, make = real(session, where)

        class Store:
            def createNewFile(self, p):  # noqa: N802
                raise OSError("lost")

            def __getattr__(self, name):
                return getattr(fs, name)

        return Store(), make

    monkeypatch.setattr(io, "_folder", broken)
    with pytest.raises(OSError, match="lost"):
        io.merge_decisions(spark, rows(("a", 2, "y")), path, ["k"], "at")
    monkeypatch.undo()
    assert read() == [("a", 1, "x")] and io.versions(spark, path) == [1]
    io.merge_decisions(spark, rows(("a", 3, "z")), path, ["k"], "at")
    # A reader that began before sees what it opened; new readers see the new version.
    assert [tuple(r) for r in held.collect()] == [("a", 1, "x")] and read() == [("a", 3, "z")]
