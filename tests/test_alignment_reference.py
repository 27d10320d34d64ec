"""Alignment, reference and view operators on hand-made frames."""

from pyspark.sql import functions as F

from folioscope.operators import alignment, reference


def test_span_map(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x c y z".split())], "a array<string>, b array<string>")
    got = df.select(alignment.span_map(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(s["at"], s["first"], s["last"]) for s in got] == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 5)]


def test_matched_words(spark):
    df = spark.createDataFrame([("one two three".split(), "one twa four".split())], "a array<string>, b array<string>")
    got = df.select(alignment.matched_words(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(s["at"], s["other"], s["exact"]) for s in got] == [(0, 0, True), (1, 1, False)]


def test_weak_hits_and_places(spark):
    hits = spark.createDataFrame([(1, 0, 3, True), (1, 1, 4, False), (1, 2, 9, False), (1, 3, 5, True)], "block int, tok int, line int, exact boolean")
    assert sorted(r.tok for r in alignment.keep_weak_hits(hits).collect()) == [0, 1, 3]
    toks = spark.createDataFrame([(1, 0, 2, 80, 100, True), (1, 1, None, None, None, False), (1, 2, 2, 30, 50, False), (1, 3, None, None, None, False)], "block int, tok int, line int, x0 int, x1 int, exact boolean")
    got = {r.tok: (r.place, r.x0, r.x1) for r in alignment.locate(toks).collect()}
    assert got == {0: ("word", 80, 100), 1: ("gap", 50, 80), 2: ("approx", 30, 50), 3: ("uncertain", None, None)}


def test_tighten(spark):
    boxes = spark.createDataFrame([("p", 1, ["alpha", "beta"], 0, 0, 100, 50), ("p", 2, ["zzz"], 0, 0, 100, 50)], "page string, block int, keys array<string>, x0 int, y0 int, x1 int, y1 int")
    words = spark.createDataFrame([("p", "alpha", 20, 10, 40, 20), ("p", "alpha", 500, 500, 520, 520)], "page string, key string, x0 int, y0 int, x1 int, y1 int")
    got = {r.block: (r.snapped, r.x0, r.y0, r.x1, r.y1) for r in alignment.tighten(boxes, words).collect()}
    assert got == {1: (True, 14, 4, 46, 26), 2: (False, 0, 0, 100, 50)}


def test_best_matches(spark):
    pairs = spark.createDataFrame([(1, 1, "abcd", "abcx"), (1, 2, "abcd", "abcd"), (2, 1, "abcd", "zzzz")], "id int, other int, a string, b string")
    assert [(r.id, r.other) for r in alignment.best_matches(pairs).collect()] == [(1, 2)]


def test_equivalent_readings(spark):
    items = spark.createDataFrame([("قال", "قَالَ", "قَالَ", None), (None, "( x )", "(x)", None), ("other", "a", "a", None), ("a", "a", "b", None), ("a", "a", "a", "human")], "a string, b string, c string, decision string")
    assert [r.decision for r in alignment.resolve_equivalent(items).collect()] == ["قَالَ", "( x )", None, None, "human"]


def test_replay(spark):
    toks = spark.createDataFrame([(1, k, f"t{k}") for k in range(5)] + [(2, 0, "u")], "block int, tok int, raw string")
    sp = spark.createDataFrame([(1, 1, 2, "X"), (1, 4, 4, ""), (2, 0, 0, None)], "block int, first int, last int, decision string")
    assert {r.block: r.text for r in alignment.replay(toks, sp).collect()} == {1: "t0 X t3", 2: None}


def test_ranges(spark):
    ranges = spark.createDataFrame([(1, "b", 2, 3), (2, "c", 1, 1)], "id int, book string, first int, last int")
    lines = spark.createDataFrame([("b", k, f"l{k}") for k in range(1, 5)], "book string, no int, text string")
    assert {r.id: r.text for r in reference.range_text(ranges, lines).collect()} == {1: "l2 l3", 2: None}


def test_contained_candidates(spark):
    c = spark.createDataFrame([(1, "b", 1, 3, 0.8), (1, "b", 2, 2, 0.9), (1, "b", 5, 6, 0.9), (1, "b", 5, 5, 0.7)], "qid int, book string, first int, last int, similarity double")
    assert sorted((r["first"], r["last"]) for r in reference.drop_contained(c).collect()) == [(2, 2), (5, 5), (5, 6)]


def test_glossary(spark):
    g = spark.createDataFrame([(0, "A", "الصبر الجميل", "patience", "e" * 1000), (1, "B", "صبر", "endurance", "x")], "pos int, term string, key string, equivalent string, explanation string")
    q = spark.createDataFrame([(1, "ترجم صبر", "ترجم صبر"), (2, "ما الصبر الجميل in english", "ما الصبر الجميل"), (3, "صبر", "صبر")], "qid int, question string, key string")
    got = {r.qid: r.equivalent for r in reference.glossary_request(q, g, "ترجم|in english").collect()}
    assert got == {1: "endurance", 2: "patience"}
    t = spark.createDataFrame([(1, ["الصبر", "x"])], "id int, words array<string>")
    assert [(r.term, r.place) for r in reference.term_entries(t, g).collect()] == [("B", 1)]


def test_grading(spark):
    rows = spark.createDataFrame([("in_sahihayn", "g", "auto", None, None), (None, "g", "auto", None, None), (None, "g", "rejected", "m", "u"), (None, "g", None, None, None), (None, None, None, "m", None)], "p string, e string, s string, m string, u string")
    status, _ = reference.grading(*[F.col(c) for c in "pesmu"])
    assert [r[0] for r in rows.select(status).collect()] == ["in_sahihayn", "external", "manual", "external_pending", "unverified"]


def test_views(spark):
    pages = spark.createDataFrame([("b", 1, "p1"), ("b", 2, "p2")], "book string, no int, page_id string")
    blocks = spark.createDataFrame([("p1", 1, "x1", "body", "B"), ("p1", 0, "x0", "page_header", "A")], "page_id string, pos int, block_id string, type string, text string")
    got = {r.page_id: (r.before, r.after, r.blocks and len(r.blocks)) for r in reference.page_view(pages, blocks).collect()}
    assert got == {"p1": (None, "p2", 2), "p2": ("p1", None, None)}
    assert reference.book_view(pages).first().page_ids == ["p1", "p2"] and reference.page_text(blocks).first().text == "B"


def test_token_places(spark):
    df = spark.createDataFrame([("one two three four".split(), "one two tree x four".split()), ("lone".split(), "a lone b".split())], "a array<string>, b array<string>")
    got = [[(m["at"], m["other"], m["exact"]) for m in r.m] for r in df.select(alignment.token_places(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [[(0, 0, True), (1, 1, True), (2, 2, False), (3, 4, False)], [(0, 1, False)]]
    assert alignment.edit_distance("kitten", "sitting") == 3 and alignment.edit_distance("", "ab") == 2


def test_duplicate_runs(spark):
    from folioscope.operators import structure

    text = [f"w{k}" for k in range(40)]
    rows = [("p", 0, 1, text[:20]), ("p", 1, 2, ["x", *text[5:20], "y", *text[20:33]]), ("p", 2, 3, text[20:33]), ("q", 0, 4, text[:20])]
    df = spark.createDataFrame(rows, "page string, pos int, id int, words array<string>")
    # The second block is flagged at its first repeated run, so its later ones are nobody's.
    assert [tuple(r) for r in structure.duplicate_runs(df).collect()] == [("p", 2, 1)]
    again = structure.repeated_shingles(df, "page").collect()
    assert sorted((r.id, r.owner) for r in again) == [(2, 1), (3, 2)]


def test_uncovered_lines(spark):
    key = "كتاب الصبر والشكر"
    df = spark.createDataFrame([("p", 60.0, 1, key, 20.0), ("p", 40.0, 1, key, 20.0), ("p", 60.0, 1, "كتاب الصبر", 20.0), ("p", 60.0, 2, "كتاب الصبر", 20.0), ("p", 60.0, 1, key, 90.0), ("p", 60.0, 1, "كتاب الصبر abcdefghi", 1.0)], "page string, conf double, n_segments int, key string, s double")
    assert [(r.n_segments, r.key) for r in reference.uncovered_lines(df, F.col("s")).collect()] == [(1, key), (2, "كتاب الصبر")]


def test_candidate_readings(spark):
    from folioscope.operators import review

    df = spark.createDataFrame([(1, 0, [("B", "x y"), ("C", ""), ("A", "x y")]), (1, 5, [("B", "p"), ("C", "q"), ("A", None)])], "block int, first int, readings array<struct<reader:string,text:string>>")
    got = {r["first"]: [(c.text, c.readers) for c in r.candidates] for r in review.candidate_readings(df).collect()}
    assert got == {0: [("x y", ["B", "A"])], 5: [("p", ["B"]), ("q", ["C"])]}
