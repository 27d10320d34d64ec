"""Passages in many texts, and with a word more or less."""

from folioscope.plans import text_queries as Q


def test_every_copy_and_changed_lengths(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett".split()
    passage, whole = " ".join(words), " ".join(words)
    more = " ".join([*words[:5], "and", "then", *words[5:]])
    less = " ".join(words[:7] + words[8:])
    texts = [f"x y {whole} z", whole, f"{whole} q", f"r {whole}", f"s t {whole}", f"x {more} z", f"x {less} the end of it"]
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.text_id, r.start): (r.similarity, r.status) for r in Q.passage_verify(spark, str(tmp_path)).collect()}
    assert [found[(t, s)] for t, s in ((0, 2), (1, 0), (2, 0), (3, 1), (4, 2))] == [(1.0, "exact")] * 5
    # "and then " is nine characters in the window of twelve words; "hotel " six in that of nine.
    assert found[(5, 1)] == (round(1 - 9 / len(more), 6), "minor_variant")
    assert found[(6, 1)] == (round(1 - 6 / len(passage), 6), "minor_variant")


def test_candidates_are_ranked_by_their_best_window(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett".split()
    # Two far texts take most places of the votes; the last holds the passage with a word less.
    near = " ".join(words[:4] + words[5:])
    texts = [" ".join(words[:8]) + " 1 2 3 4", " ".join(words[:8]) + " 5 6 7 8", " ".join(words[:8]) + " 9 9 9 9", near + " and so on"]
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((r.place, r.text_id, r.start, r.similarity) for r in Q.span_candidates(spark, str(tmp_path)).collect())
    # Most of its trigrams vote for -1, whose window begins with the text.
    assert [r[1] for r in rows] == [3, 0, 1] and rows[0] == (1, 3, -1, round(1 - 5 / len(" ".join(words)), 6))


def test_neighbours_of_the_hits_of_every_question(spark, tmp_path):
    docs = [(i, "common words here" if i not in (40, 50) else "zebra quagga okapi", "en", "s") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(31, "the zebra and the okapi")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.qid, r.place, r.id) for r in Q.neighbours(spark, str(tmp_path)).collect())
    assert got == [(31, 1, 39), (31, 2, 41), (31, 3, 38)]


def test_distances_of_all_beginnings_at_once():
    """Against the plain table of distances, at the borders of 64 bits, with empty texts and letters of any plane."""
    import random

    from folioscope.operators.spans import distances, long_distances

    def plain(a, b):
        above, ends = list(range(len(b) + 1)), [len(a)]
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
            above = row
        return above if a else list(range(len(b) + 1)) or ends

    draw = random.Random(7)
    a = ["".join(draw.choice("abé 😀") for _ in range(n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 30, 0)]
    b = [x[: draw.randint(0, len(x))] + "".join(draw.choice("abc ") for _ in range(n)) for x, n in zip(a, (4, 0, 70, 1, 3, 9, 0, 65, 5, 0), strict=True)]
    for x, y, row in zip(a, b, distances(a, b), strict=True):
        assert long_distances(x, y) == row[: len(y) + 1].tolist() == plain(x, y)


def test_windows_are_compared_once_for_all_lengths(spark):
    """One comparison a start, however many lengths, as Spark's own distance has them; long passages too."""
    from pyspark.sql import functions as F

    from folioscope.operators import spans

    words = [f"w{i % 37}é" for i in range(260)]
    passages = spark.createDataFrame([(0, words[:9]), (1, words)], "id long, words array<string>")
    texts = spark.createDataFrame([(5, ["x", *words[:4], "new", *words[5:]])], "id long, words array<string>")
    rows = spans.windows(spans.votes(passages, texts), passages, texts, slack=2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan
    same = F.round(spans.similarity(F.col("passage"), F.col("window")), 6) == F.col("similarity")
    assert rows.count() > 10 and rows.where(~same).count() == 0 and rows.groupBy("passage_id", "text_id", "start").count().where("count <> 5").count() == 0


def test_runs_of_texts_are_read_once(spark, monkeypatch):
    """The check of unmarked quotations reads the texts for the runs only."""
    from folioscope.operators import verses

    ref = verses.reference_stream(spark.createDataFrame([(0, 0, "a b c d e f g h i j k".split())], "book int, no int, words array<string>"))
    texts = spark.createDataFrame([(1, "x y a b c d e f g h i j k z".split())], "qid long, words array<string>")
    written, real = [], verses.scratch
    monkeypatch.setattr(verses, "scratch", lambda df, label: (written.append(label), real(df, label))[1])
    rows = verses.find_unmarked(texts, ref).collect()
    assert written == ["runs"] and [(r.qid, r.at, r.status) for r in rows] == [(1, 2, "exact")]


def test_measures_read_no_text_of_a_pair_with_few_votes(spark, tmp_path):
    """A text that holds a passage whole is found by its votes at one start; two halves apart are not whole."""
    from folioscope.plans import rule_queries as R

    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett".split()
    texts = [" ".join(["x", *words, "y"]), " ".join([*words[:8], "gap", *words[2:]]), " ".join(words[:5]), None]
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = R.prf(spark, str(tmp_path))
    assert [(r.n_gold, r.n_found, r.n_both) for r in df.collect()] == [(1, 2, 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") == 0 and "size" in plan and "votes" in plan
