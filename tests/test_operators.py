"""Operators on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking, fuzzy, gates, metrics, relational, retrieval, review, spans, structure


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_links(spark):
    anchors = spark.createDataFrame([(1, 1, "1"), (1, 2, "2"), (1, 3, "2"), (1, 4, "9")], "page int, ord int, marker string")
    notes = spark.createDataFrame([(1, 1, "1"), (1, 2, "2"), (1, 3, "5"), (1, 4, None)], "page int, ord int, marker string")
    links = structure.link_notes(anchors, notes)
    assert rows(links, "anchor_ord") == [(1, 1, 1, 1.0, "exact"), (1, 2, 2, 1.0, "exact"), (1, 3, 3, 0.6, "ordinal")]
    assert rows(structure.unlinked(anchors, links, "anchor_ord").select("ord"), "ord") == [(4,)]
    left = structure.continuations(notes.withColumn("continues", F.lit(True)), links)
    assert rows(left, "note_ord") == [(1, 4, 0.7, "continuation")]


def test_note_runs_are_sorted(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 3), (1, 3, 1), (1, 4, 2), (1, 5, None), (1, 6, 5), (1, 7, 4)], "page int, ord int, num int")
    assert [r.ord for r in structure.order_note_runs(df, "page", "ord", "num").orderBy("seq").collect()] == [1, 3, 4, 2, 5, 7, 6]


def test_regions(spark):
    lines = spark.createDataFrame([(1, 0, 0, 10, 50, "a"), (1, 0, 100, 20, 150, "b"), (1, 0, 400, 10, 420, "c")], "page int, x0 int, y0 int, x1 int, y1 int, text string")
    assert rows(structure.merge_regions(lines), "y0") == [(1, 0, 0, 20, 150, ["a", "b"]), (1, 0, 400, 10, 420, ["c"])]


def test_boxes(spark):
    df = spark.createDataFrame([((0, 0, 10, 10), (5, 0, 15, 10)), ((0, 0, 1, 1), (5, 5, 6, 6))], "a struct<x0:int,y0:int,x1:int,y1:int>, b struct<x0:int,y0:int,x1:int,y1:int>")
    assert [round(r[0], 4) for r in df.select(structure.iou(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0]


def test_cluster(spark):
    words = spark.createDataFrame([(1, n, f"w{k}") for k, n in enumerate([1, 2, 2, 9, 10, 10, 11])], "block int, line int, w string")
    assert {r.line for r in structure.densest_cluster(words).collect()} == {9, 10, 11}


def test_repeated_shingles(spark):
    run = [f"r{k}" for k in range(12)]
    df = spark.createDataFrame([(1, "s", run + ["x"]), (2, "s", ["y"] + run), (3, "t", run), (4, "s", ["z"] * 5)], "id int, scope string, words array<string>")
    assert rows(structure.repeated_shingles(df, "scope"), "id") == [("s", 2, 1)]


def test_verification(spark):
    base = "one two three four five six seven eight nine ten"
    passages = spark.createDataFrame([(1, base.split())], "id long, words array<string>")
    texts = spark.createDataFrame([(1, f"a b {base} c".split()), (2, base.replace("five", "fire").split()), (3, "nothing in common here at all".split()), (4, base.replace("three four five", "u v w").split())], "id long, words array<string>")
    found = spans.windows(spans.best_starts(spans.votes(passages, texts)), passages, texts)
    got = {r.text_id: r.status for r in spans.verify_spans(found).collect()}
    assert got == {1: "exact", 2: "minor_variant", 4: "mismatch"}
    assert rows(spans.runs(texts, passages), "text_id") == [(1, 2, 11, 10)]


def test_ratios(spark):
    df = spark.createDataFrame([("needle", "hay needle hay"), ("abc", "xyz"), ("b a", "a b c")], "a string, b string")
    out = df.select(fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p"), fuzzy.token_set_ratio(F.col("a"), F.col("b")).alias("t")).collect()
    assert out[0].p == 100 and out[1].p == 0 and out[2].t == 100


def test_windows_pack():
    assert chunking.pack_windows([1000, 900, 800, 100], 1800) == [(0, 0), (1, 3)]
    assert chunking.pack_windows([900, 900], 1800) == [(0, 1)] and chunking.pack_windows([900, 900, 1], 1800) == [(0, 1), (1, 2)]
    assert chunking.pack_windows([0, 3000, 5], 1800) == [(0, 1), (1, 1), (2, 2)]
    assert chunking.pack_windows([5000], 1800) == [(0, 0)] and chunking.pack_windows([], 10) == []
    for seed in range(20):
        sizes = [random.Random(seed).randint(1, 900) for _ in range(30)]
        spans_ = chunking.pack_windows(sizes, 1800)
        assert spans_[0][0] == 0 and spans_[-1][1] == 29
        assert all(a[0] < b[0] <= a[1] + 1 for a, b in zip(spans_, spans_[1:], strict=False))


@pytest.mark.parametrize("size", [7, 50])
def test_fixed_chunks(spark, size):
    texts = [(k % 2, k, "ab\ncd" * k) for k in range(7)]
    df = spark.createDataFrame(texts, "g int, k int, t string")
    got = {(r["by"], r.chunk): r.text for r in chunking.fixed_chunks(df, "g", "k", "t", size, 2).collect()}
    for g in (0, 1):
        whole = "".join(t.replace("\n", " ") + " " for h, _, t in texts if h == g)
        want = {i: whole[i * (size - 2) : i * (size - 2) + size] for i in range((len(whole) - 1) // (size - 2) + 1)}
        assert {c: t for (h, c), t in got.items() if h == g} == want


BLOCKS = "book string, pos int, block_id string, type string, author_role string, text string, continues_from_prev boolean, starts boolean, ends boolean, attached_to string"


def chunked(spark, rows):
    """rows: (type, role, text, continues, starts, attached)."""
    data = [("b", k, f"x{k}", t, r, text, c, s, text.endswith("."), a) for k, (t, r, text, c, s, a) in enumerate(rows)]
    return {r.block_id: r for r in chunking.structural_chunks(spark.createDataFrame(data, BLOCKS)).collect()}


def test_structural_chunks(spark):
    main = lambda text, goes=False, starts=False: ("body", "matn", text, goes, starts, None)
    note = ("editor_commentary", "matn", "said the editor.", False, False, None)
    got = chunked(spark, [("heading", "matn", "Part", False, False, None), main("one."), note, ("body", "editor", "more", False, False, None), main("goes on.", True), ("footnote", "matn", "(1) n", False, False, None),
                          main("a new unit", False, True), ("poetry", "matn", "verse", False, False, "x5"), main("still", True, True), ("heading", "matn", "other", False, False, None), main("after."), ("heading", "matn", "باب النية", False, False, None), main("last.")])
    assert {k: r.chunk for k, r in got.items()} == {"x1": 0, "x2": 1, "x3": 1, "x4": 0, "x6": 2, "x8": 2, "x10": 3, "x12": 4}
    assert (got["x2"].kind, got["x2"].commentary_on, got["x4"].kind, got["x1"].commentary_on) == ("editor_commentary", 0, "matn", None)
    assert [got[k].chapter for k in ("x1", "x10", "x12")] == ["Part", "Part", "باب النية"]


def test_long_units_are_cut_where_a_sentence_ends(spark):
    body = lambda text, goes=False: ("body", "matn", text, goes, False, None)
    got = chunked(spark, [body("a" * 2300), body("b."), body("c.", True), body("d"), ("heading", "matn", "h", False, False, None), body("e.", True)])
    assert {k: r.chunk for k, r in got.items()} == {"x0": 0, "x1": 0, "x2": 0, "x3": 1, "x5": 2}


def test_commentary_is_attached_to_the_noted_chunk(spark):
    data = [("b", 0, "m0", "body", "matn", "first hadith words", "p1"), ("b", 1, "m1", "body", "matn", "second", "p1"), ("b", 2, "f0", "footnote", "editor", "(1) n", "p1"), ("b", 3, "e0", "editor_commentary", "editor", "about it", "p1"), ("b", 4, "m2", "body", "matn", "third", "p2"), ("b", 5, "e1", "editor_commentary", "editor", "on third", "p2")]
    blocks = spark.createDataFrame(data, "book string, pos int, block_id string, type string, author_role string, text string, page_id string")
    chunks = spark.createDataFrame([("b", "m0", 0, "matn", None), ("b", "m1", 1, "matn", None), ("b", "e0", 2, "editor_commentary", 1), ("b", "m2", 3, "matn", None), ("b", "e1", 4, "editor_commentary", 3)], "book string, block_id string, chunk long, kind string, commentary_on long")
    links = spark.createDataFrame([("f0", "m0")], "note_id string, anchor string")
    got = {r.chunk: (r.target, r.about) for r in chunking.attach_commentary(chunks, blocks.where("true").withColumn("commentary_on", F.lit(None)).drop("commentary_on"), links).collect()}
    assert got == {2: (0, "first hadith words"), 4: (3, "third")}


def test_bm25_prefix_terms(spark):
    texts = spark.createDataFrame([(1, ["compute", "x"]), (2, ["computer"]), (3, ["y"] * 4), (4, ["z"]), (5, ["z"])], "id long, words array<string>")
    q = spark.createDataFrame([(0, "comp")], "qid int, qterm string")
    assert [r.id for r in retrieval.ranked(retrieval.bm25(texts, q, prefix=True), 5).collect()] == [2, 1]
    assert retrieval.bm25(texts, q).count() == 0


def test_fusion_breaks_ties_by_priority(spark):
    one = spark.createDataFrame([(0, 5, 1)], "qid int, id int, rank int")
    two = spark.createDataFrame([(0, 3, 1), (0, 5, 2)], "qid int, id int, rank int")
    three = spark.createDataFrame([(0, 9, 1)], "qid int, id int, rank int")
    got = retrieval.fuse([("phrase", one), ("bm25", two), ("dense", three)]).orderBy("rank").collect()
    assert [r.id for r in got] == [5, 3, 9] and got[0].phrase_rank == 1 and got[0].dense_rank is None


def test_quotes(spark):
    p = spark.createDataFrame([("P1", "the quick brown fox jumps", "note")], "tag string, hay string, note string")
    q = spark.createDataFrame([(1, "[P1]", "quick brown"), (1, "P1", "quick red"), (1, "P2", "quick brown"), (1, "P1", "fox"), (1, "P1", "note"), (1, "P1", "uick brown")], "qid int, tag string, key string")
    got = {(r.tag, r.key): r.reason for r in gates.verify_quotes(q, p).collect()}
    assert got == {("P1", "quick brown"): None, ("P1", "quick red"): "not in passage", ("P2", "quick brown"): "unknown tag", ("P1", "fox"): "too short", ("P1", "note"): None, ("P1", "uick brown"): "not in passage"}
    assert gates.withdraw(gates.verify_quotes(q, p)).first().withdrawn


def test_disputes(spark):
    df = spark.createDataFrame([(1, k, "disputed" if k in (0, 1, 2, 3, 4, 7) else "agree") for k in range(9)], "block int, tok int, status string")
    assert rows(review.dispute_groups(df), "first") == [(1, 0, 3), (1, 4, 4), (1, 7, 7)]


def test_rate_limit_keeps_rejected_out():
    assert review.accept([0, 1, 2, 3600, 3601], 2) == [True, True, False, False, True]
    assert review.accept([0, 3600, 3600.5], 1) == [True, False, True]


def test_rate_limit_over_gaps(spark):
    rng = random.Random(3)
    times = [(k, k % 3, rng.choice([0, 0, 9000, 20000]) + rng.randint(0, 4000)) for k in range(300)]
    events = spark.createDataFrame(times, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in review.rate_limit(events, limit=4).collect()}
    want = {}
    for u in range(3):
        own = sorted((s, k) for k, v, s in times if v == u)
        want |= dict(zip([k for _, k in own], review.accept([s for s, _ in own], 4), strict=True))
    assert got == want and not all(got.values())


def test_rate_limit_rejects_thirty(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert review.rate_limit(events, limit=2).where("not allowed").count() == 30


def test_latest_and_decisions(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert rows(review.latest(d, ["k"], "at"), "k") == [("a", 2, "y"), ("b", 1, "z")]
    drafts = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, q string")
    dec = spark.createDataFrame([("a", "remove", None), ("b", "edit", "B")], "k string, action string, value string")
    assert [(r.k, r.q, r.verified) for r in review.decide(drafts, dec, "k", "q").orderBy("k").collect()] == [("b", "B", True), ("c", "3", False)]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c d e", "a x c d"), ("", ""), ("", "a")], "r string, h string")
    assert [round(r[0], 4) for r in df.select(metrics.wer(F.col("r"), F.col("h"))).collect()] == [0.4, 0.0, 1.0]
    assert [round(r[0], 4) for r in df.select(metrics.cer(F.col("r"), F.col("h"))).collect()] == [0.3333, 0.0, 1.0]


def test_asof_and_range_join(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (2, 10, 99)], "k int, at int, v int")
    assert rows(relational.asof(left, right, ["k"], "at", ["v"]).select("name", "v"), "name") == [("a", 50), ("b", None), ("c", None)]
    pts = spark.createDataFrame([(1.0,), (5.0,), (9.9,)], "x double")
    rng = spark.createDataFrame([(0.0, 5.0), (5.0, 9.9)], "lo double, hi double")
    got = relational.range_join(pts, rng, F.col("x"), F.col("lo"), F.col("hi"), 3.0)
    assert rows(got, "x") == [(1.0, 0.0, 5.0), (5.0, 5.0, 9.9)]


def test_shingles_are_moved_once(spark, monkeypatch):
    """No table of all runs is written and joined with itself; null scopes and ids share nothing."""
    data = [("s", 1, "a b c d"), ("s", 2, "x a b c"), ("s", 3, "x a b"), ("t", 4, "a b c"), (None, 5, "a b c"), (None, 6, "a b c"), ("s", None, "a b c")]
    df = spark.createDataFrame(data, "scope string, id long, t string").selectExpr("scope", "id", "split(t, ' ') words")
    monkeypatch.delattr("folioscope.operators.structure.scratch")
    found = structure.repeated_shingles(df, "scope", n=3)
    assert rows(found, "id") == [("s", 2, 1), ("s", 3, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_only_lengths_of_blocks_reach_python(spark):
    """Windows are folded over lengths, so a batch holds no texts; lengths are counted in characters."""
    df = spark.createDataFrame([(1, ["é" * 3, None, "\U0001f600" * 4, "abc"]), (2, []), (3, ["x"])], "id int, blocks array<string>")
    found = chunking.search_windows(df, trigger=5, most=7)
    assert rows(found, "id", "window") == [(1, 0, 0, 2, 9), (1, 1, 2, 3, 8), (3, 0, 0, 0, 1)]
    sent = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert sent and "blocks" not in sent[0].split("]")[0].replace("transform(blocks", "") and "length(" in sent[0]


def test_marker_point_walks_the_lines_once(spark):
    """A block of very many lines: each line is looked at once, in order."""
    from pyspark.sql import functions as F

    from folioscope.operators import structure

    n = 3000
    rects = [(0, 10 * i, 10, 10 * i + 4) for i in range(n)]
    rows = spark.createDataFrame([(0, 1234, 3000, rects), (1, None, 7, rects), (2, 9000, 3000, rects), (3, 1, 1, [])], "id int, off int, n int, rects array<struct<x0:int,y0:int,x1:int,y1:int>>")
    out = rows.select("id", structure.marker_point(F.col("off"), F.col("n"), F.col("rects")).alias("p"))
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.p and (round(r.p.x, 6), r.p.y) for r in out.collect()}
    # A target at a line's very end belongs to it; beyond the last line the last one counts.
    assert got == {0: (0.0, 1233 * 10 + 2.0), 1: (0.0, 1499 * 10 + 2.0), 2: (0.0, 2999 * 10 + 2.0), 3: None}


def test_a_chunks_anchor_needs_no_list_of_its_blocks(spark, tmp_path):
    """The first block of the kind, else the first, with and without lists; the query makes none."""
    from folioscope.operators import reference
    from folioscope.plans import answer_queries as A

    kinds = spark.createDataFrame([(4, "hadith"), (5, "body"), (7, "body"), (8, "hadith")], "block_id long, type string")
    rows = spark.createDataFrame([(1, 2, 8), (1, 1, 5), (1, 3, 4), (2, 9, 7), (2, 8, 5), (3, 1, 6)], "chunk long, pos int, block_id long")
    lists = spark.createDataFrame([(1, [5, 8, 4]), (2, [5, 7]), (3, [6])], "chunk long, block_ids array<long>")
    got = [sorted(map(tuple, reference.chunk_anchors(c, kinds).collect())) for c in (rows, lists)]
    assert got == [[(1, 8), (2, 5), (3, 6)]] * 2
    lines = [(1, 2, 8, 1, 1.0, 1.0), (1, 1, 5, 1, 1.0, 1.0), (2, 1, 3, 1, 1.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = A.chunk_anchors(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 8), (2, 3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_stretches_are_rows_not_groups_of_python(spark):
    """Cuts by size of many short books and of one over several stretches, without a group for each."""
    from folioscope.operators import chunking

    books = [(b, p // 4, p, 40, p == 0, p > 0) for b in range(30) for p in range(10)] + [(99, 0, 0, 500, True, False)]
    rows = spark.createDataFrame(books, "book int, stretch long, pos long, n int, opens boolean, may_cut boolean")
    df = chunking.size_cuts(rows, 100)
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.collect()
    assert len(got) == 301 and {(r.pos, r.cut) for r in got if r.book < 30} == {(p, p in (3, 6, 9)) for p in range(10)}
    assert [r.cut for r in got if r.book == 99] == [False]


def test_markers_are_read_once_for_each_print(spark, tmp_path):
    """The number of a marker is made after the count of its places."""
    from folioscope.plans import text_queries as Q

    spark.createDataFrame([(1, "a. b. " + "c" * 9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q.marker_extract(spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(1, "(15)", "15", 2)]
    line = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x)
    assert "raw" in line.split("]")[0] and "marker" not in line.split("]")[0]


def test_windows_index_has_larger_blocks(spark, monkeypatch):
    """Short texts share a block of the index, which bounds what is held by parts, not by terms."""
    from folioscope.operators import postings
    from folioscope.plans import unit_queries as U

    assert U.WINDOW_BLOCK * U.WINDOW >= postings.BLOCK_TEXTS * 100
    texts = spark.createDataFrame([(i, f"alpha word{i % 3} beta") for i in range(40)], "id long, key string")
    monkeypatch.setattr(postings, "PARTS", 80)
    one = postings.standing(spark, "small blocks", lambda: texts, 10)
    two = postings.standing(spark, "a large block", lambda: texts, 1000)
    assert one.blocks.count() > two.blocks.count() == 1
    asked = spark.createDataFrame([(1, "alpha"), (1, "word2"), (2, "beta")], "qid long, qterm string")
    got = [sorted(map(tuple, postings.lexical_top(i, asked, 5).collect())) for i in (one, two)]
    assert got[0] == got[1] and len(got[0]) == 10
