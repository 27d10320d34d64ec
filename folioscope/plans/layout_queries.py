"""Queries on notes, regions, boxes and readings. Order lines stand for what lies on a page (an order):
their number is the reading order, their figures are places and sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import alignment, fuzzy, metrics, reference, review, structure
from folioscope.sources.io import table

from .registry import key_sql, registry, words_sql

QUERIES, ORACLES, query = registry()

#: A page's pieces in reading order: page, ord, x0, y0, x1, y1.
_PIECES = """pc AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, CAST(l_suppkey % 40 * 10 AS INTEGER) AS x0, CAST(l_partkey % 60 * 20 AS INTEGER) AS y0,
  CAST(l_suppkey % 40 * 10 + 20 + l_quantity * 4 AS INTEGER) AS x1, CAST(l_partkey % 60 * 20 + 18 + l_partkey % 5 AS INTEGER) AS y1, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


def pieces(spark, d):
    q, p, s = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("ord"), (s % 40 * 10).cast("int").alias("x0"), (p % 60 * 20).cast("int").alias("y0"), (s % 40 * 10 + 20 + q * 4).cast("int").alias("x1"), (p % 60 * 20 + 18 + p % 5).cast("int").alias("y1"), p.alias("part"), s.alias("supp"))
    return rows


def longs(df, *keep):
    return df.select(*keep, *[F.col(c).cast("long").alias(c) for c in df.columns if c not in keep])


@query(f"""
WITH {_PIECES}, a AS (SELECT page, ord, CASE WHEN part % 4 > 0 THEN CAST(part % 4 AS VARCHAR) END AS marker, supp % 3 = 0 AS goes FROM pc),
l AS (SELECT page, ord FROM pc WHERE supp % 2 = 0),
n AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page = a.page AND l.ord = a.ord))
SELECT page, ord AS note_ord, CASE WHEN marker IS NULL AND goes THEN 0.7::DOUBLE END AS confidence, CASE WHEN marker IS NULL AND goes THEN 'continuation' ELSE 'unmatched' END AS method FROM n""")
def loose_notes(spark, d):
    """Notes that no link has: continuations of the page before, or unmatched."""
    p = pieces(spark, d)
    notes = p.select("page", "ord", F.when(F.col("part") % 4 > 0, (F.col("part") % 4).cast("string")).alias("marker"), (F.col("supp") % 3 == 0).alias("continues"))
    links = p.where("supp % 2 = 0").select("page", F.col("ord").alias("note_ord"))
    return structure.continuations(notes, links)


@query(f"""
WITH {_PIECES}, l AS (SELECT page, ord FROM pc WHERE part % 3 = 0)
SELECT page, ord FROM pc WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page = pc.page AND l.ord = pc.ord)""")
def loose_anchors(spark, d):
    """Anchors without a link."""
    p = pieces(spark, d)
    return structure.unlinked(p.select("page", "ord"), p.where("part % 3 = 0").select("page", F.col("ord").alias("anchor_ord")), "anchor_ord").select("page", "ord")


@query(f"""
WITH {_PIECES}, b AS (SELECT page, ord, CASE WHEN part % 4 > 0 THEN CAST(part % 9 AS INTEGER) END AS num FROM pc),
c AS (SELECT *, CASE WHEN num IS NULL OR coalesce((num IS NOT NULL) <> (lag(num) OVER w IS NOT NULL), true) OR lag(ord) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY page ORDER BY ord)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY ord) AS island FROM c)
SELECT page, ord, CAST(row_number() OVER (PARTITION BY page ORDER BY island, coalesce(num, 0), ord) AS BIGINT) AS seq FROM i""")
def note_order(spark, d):
    """Each run of numbered notes in the order of its numbers."""
    rows = pieces(spark, d).select("page", "ord", F.when(F.col("part") % 4 > 0, (F.col("part") % 9).cast("int")).alias("num"))
    return structure.order_note_runs(rows, "page", "ord", "num").select("page", "ord", F.col("seq").cast("long").alias("seq"))


@query(f"""
WITH {_PIECES}, m AS (SELECT *, CASE WHEN coalesce(y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 120, true) THEN 1 ELSE 0 END AS fresh FROM pc),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT page, CAST(min(x0) AS BIGINT) AS x0, CAST(min(y0) AS BIGINT) AS y0, CAST(max(x1) AS BIGINT) AS x1, CAST(max(y1) AS BIGINT) AS y1, count(*) AS n_lines FROM i GROUP BY page, island""")
def line_regions(spark, d):
    """Lines within 120 of the region above are one region, with the union of their boxes."""
    rows = structure.merge_regions(pieces(spark, d).withColumn("text", F.col("ord").cast("string")))
    return longs(rows.withColumn("n_lines", F.size("lines")).drop("lines"), "page")


@query(f"""
WITH {_PIECES}, p AS (SELECT a.page, a.ord, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM pc a JOIN pc b ON b.page = a.page AND b.ord = a.ord + 1),
s AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS both_area FROM p),
u AS (SELECT *, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both_area AS area FROM s)
SELECT page, ord, round(CASE WHEN area > 0 THEN both_area / area::DOUBLE ELSE 0 END, 6) AS iou, coalesce(CASE WHEN area > 0 THEN both_area / area::DOUBLE ELSE 0 END >= 0.5, false) AS agree, CAST(CASE WHEN coalesce(CASE WHEN area > 0 THEN both_area / area::DOUBLE ELSE 0 END >= 0.5, false) THEN ax0 ELSE bx0 END AS BIGINT) AS x0 FROM u""")
def box_lanes(spark, d):
    """Two boxes of a block: how far they agree, and which one is kept."""
    p = pieces(spark, d)
    box = lambda t: F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias(t)
    a, b = p.select("page", "ord", box("ocr")), p.select("page", (F.col("ord") - 1).alias("ord"), box("box"))
    rows = structure.fuse_lanes(a.join(b, ["page", "ord"]).withColumn("iou", F.round(structure.iou(F.col("ocr"), F.col("box")), 6)))
    return rows.select("page", F.col("ord").cast("long").alias("ord"), "iou", "agree", F.col("place.x0").cast("long").alias("x0"))


@query("""
WITH b AS (SELECT o_orderkey AS page, [o_custkey % 900, o_orderkey % 800, o_custkey % 900 + 90, o_orderkey % 800 + 150] AS box FROM orders)
SELECT page, CAST(round(box[2] * 1240 / 1000.0::DOUBLE) AS BIGINT) AS x0, CAST(round(box[1] * 1754 / 1000.0::DOUBLE) AS BIGINT) AS y0, CAST(round(box[4] * 1240 / 1000.0::DOUBLE) AS BIGINT) AS x1, CAST(round(box[3] * 1754 / 1000.0::DOUBLE) AS BIGINT) AS y1 FROM b""")
def scaled_boxes(spark, d):
    """Boxes in thousandths as pixels of a page of 1240 by 1754."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    box = F.array(c % 900, o % 800, c % 900 + 90, o % 800 + 150)
    rows = table(spark, d, "orders").select(o.alias("page"), structure.scale_box(box, F.lit(1240), F.lit(1754)).alias("b"))
    return longs(rows.select("page", "b.*"), "page")


@query(f"""
WITH {_PIECES}, w AS (SELECT supp AS block, part % 30 AS line FROM pc), l AS (SELECT block, line, count(*) AS n FROM w GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN coalesce(line - lag(line) OVER (PARTITION BY block ORDER BY line) > 2, true) THEN 1 ELSE 0 END AS fresh FROM l),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY block ORDER BY line) AS island FROM f), s AS (SELECT block, island, sum(n) AS n FROM i GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, island) AS k FROM s) WHERE k = 1)
SELECT i.block, min(line) AS first, max(line) AS last, CAST(sum(i.n) AS BIGINT) AS n_words FROM i JOIN b ON b.block = i.block AND b.island = i.island GROUP BY 1""")
def word_clusters(spark, d):
    """The cluster of lines that holds most of a block's matched words."""
    rows = pieces(spark, d).select(F.col("supp").alias("block"), (F.col("part") % 30).alias("line"))
    return structure.densest_cluster(rows).groupBy("block").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n_words"))


@query(f"""
WITH {_PIECES}, r AS (SELECT page AS block, part % 3 AS line, 0 AS lx0, 900 AS lx1, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM pc GROUP BY 1, 2)
SELECT block, line, CAST(CASE WHEN line = max(line) OVER w THEN x0 ELSE lx0 END AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(CASE WHEN line = min(line) OVER w THEN x1 ELSE lx1 END AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM r WINDOW w AS (PARTITION BY block)""")
def line_boxes(spark, d):
    """One rectangle a line, right to left."""
    rows = pieces(spark, d).select(F.col("page").alias("block"), (F.col("part") % 3).alias("line"), "x0", "y0", "x1", "y1", F.lit(0).alias("lx0"), F.lit(900).alias("lx1"))
    return longs(structure.line_rects(rows), "block", "line")


_GAPS = f"""{_PIECES}, bl AS (SELECT page, ord, CASE WHEN part % 3 > 0 THEN x0 END AS x0, CASE WHEN part % 3 > 0 THEN ord * 100 END AS y0, CASE WHEN part % 3 > 0 THEN ord * 100 + 80 END AS y1 FROM pc),
ln AS (SELECT page, x0, ord * 100 + supp % 30 AS y0, x1, ord * 100 + supp % 30 + 40 AS y1 FROM pc)"""


@query(f"""
WITH {_GAPS}, g AS (SELECT page, ord, y0, coalesce(last_value(y1 IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, coalesce(first_value(y0 IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000) AS low FROM bl)
SELECT g.page, g.ord, CAST(min(ln.x0) AS BIGINT) AS x0, CAST(min(ln.y0) AS BIGINT) AS y0, CAST(max(ln.x1) AS BIGINT) AS x1, CAST(max(ln.y1) AS BIGINT) AS y1, count(*) AS n_lines
FROM g JOIN ln ON ln.page = g.page AND ln.y0 >= g.top - 5 AND ln.y1 <= g.low + 5 WHERE g.y0 IS NULL GROUP BY 1, 2""")
def filled_gaps(spark, d):
    """Blocks that were not found take the lines between their neighbours."""
    p = pieces(spark, d)
    found = F.col("part") % 3 > 0
    blocks = p.select("page", "ord", F.when(found, F.col("x0")).alias("x0"), F.when(found, F.col("ord") * 100).alias("y0"), F.when(found, F.col("x1")).alias("x1"), F.when(found, F.col("ord") * 100 + 80).alias("y1"))
    lines = p.select("page", "x0", (F.col("ord") * 100 + F.col("supp") % 30).alias("y0"), "x1", (F.col("ord") * 100 + F.col("supp") % 30 + 40).alias("y1"))
    return longs(structure.interpolated_boxes(blocks, lines, p.select("page").distinct().withColumn("height", F.lit(1000))), "page", "ord")


@query(f"WITH {_PIECES} SELECT page, ord, round(CASE WHEN part % 6 > 0 THEN least((supp % 8) / (part % 6)::DOUBLE, 1.0) ELSE 0 END, 3) AS score, CASE WHEN round(CASE WHEN part % 6 > 0 THEN least((supp % 8) / (part % 6)::DOUBLE, 1.0) ELSE 0 END, 3) >= 0.3 THEN 'fusion' ELSE 'none' END AS source FROM pc")
def block_scores(spark, d):
    """Share of a block's words that were matched, and whether that is enough."""
    score = alignment.alignment_score(F.col("supp") % 8, F.col("part") % 6)
    return pieces(spark, d).select("page", "ord", score.alias("score"), alignment.alignment_source(score).alias("source"))


@query("""
WITH b AS (SELECT o_orderkey AS page, o_custkey % 3 AS block, ['word' || o_custkey % 5, 'page' || o_custkey % 7, 'line'] AS keys, 100 AS x0, 100 AS y0, 400 AS x1, 300 AS y1 FROM orders),
w AS (SELECT l_orderkey AS page, CASE l_partkey % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'pages' ELSE 'other' END || l_suppkey % 5 AS key, CAST(l_partkey % 500 AS INTEGER) AS x0, CAST(l_suppkey % 400 AS INTEGER) AS y0, CAST(l_partkey % 500 + 40 AS INTEGER) AS x1, CAST(l_suppkey % 400 + 20 AS INTEGER) AS y1 FROM lineitem),
h AS (SELECT b.page, b.block, count(*) AS hits, min(w.x0) AS hx0, min(w.y0) AS hy0, max(w.x1) AS hx1, max(w.y1) AS hy1 FROM b JOIN w ON w.page = b.page
  WHERE (w.x0 + w.x1) / 2.0::DOUBLE BETWEEN 85 AND 415 AND (w.y0 + w.y1) / 2.0::DOUBLE BETWEEN 85 AND 315 AND len(list_filter(keys, lambda k: 1 - levenshtein(k, w.key) / greatest(length(k), length(w.key), 1)::DOUBLE >= 0.6)) > 0 GROUP BY 1, 2)
SELECT b.page, b.block, coalesce(hits >= 1, false) AS snapped, CAST(CASE WHEN hits >= 1 THEN hx0 - 6 ELSE 100 END AS BIGINT) AS x0, CAST(CASE WHEN hits >= 1 THEN hy0 - 6 ELSE 100 END AS BIGINT) AS y0, CAST(CASE WHEN hits >= 1 THEN hx1 + 6 ELSE 400 END AS BIGINT) AS x1, CAST(CASE WHEN hits >= 1 THEN hy1 + 6 ELSE 300 END AS BIGINT) AS y1 FROM b LEFT JOIN h USING (page, block)""")
def snapped_boxes(spark, d):
    """Boxes snapped to the OCR words in them that resemble the block's."""
    c = F.col("o_custkey")
    keys = F.array(F.concat(F.lit("word"), (c % 5).cast("string")), F.concat(F.lit("page"), (c % 7).cast("string")), F.lit("line"))
    boxes = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (c % 3).alias("block"), keys.alias("keys"), *[F.lit(v).alias(n) for n, v in (("x0", 100), ("y0", 100), ("x1", 400), ("y1", 300))])
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    word = F.concat(F.when(p % 3 == 0, "word").when(p % 3 == 1, "pages").otherwise("other"), (s % 5).cast("string"))
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), word.alias("key"), (p % 500).cast("int").alias("x0"), (s % 400).cast("int").alias("y0"), (p % 500 + 40).cast("int").alias("x1"), (s % 400 + 20).cast("int").alias("y1"))
    return longs(alignment.tighten(boxes, words).drop("keys"), "page", "block", "snapped")


@query(f"""
WITH {_PIECES}, h AS (SELECT page AS block, ord AS tok, CAST(part % 14 AS INTEGER) AS line, supp % 3 = 0 AS exact FROM pc),
a AS (SELECT *, last_value(CASE WHEN exact THEN line END IGNORE NULLS) OVER (PARTITION BY block ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(CASE WHEN exact THEN line END IGNORE NULLS) OVER (PARTITION BY block ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM h)
SELECT block, tok, line, exact FROM a WHERE exact OR (coalesce(line >= lo, true) AND coalesce(line <= hi, true) AND coalesce(hi - lo <= 6, true))""")
def kept_hits(spark, d):
    """Approximate places stay between the sure ones around them."""
    rows = pieces(spark, d).select(F.col("page").alias("block"), F.col("ord").alias("tok"), (F.col("part") % 14).cast("int").alias("line"), (F.col("supp") % 3 == 0).alias("exact"))
    return alignment.keep_weak_hits(rows)


@query(f"""
WITH {_PIECES}, t AS (SELECT page AS block, ord AS tok, CASE WHEN part % 3 > 0 THEN CAST(supp % 2 AS INTEGER) END AS line, CASE WHEN part % 3 > 0 THEN 1000 - ord * 60 END AS x0, CASE WHEN part % 3 > 0 THEN 1050 - ord * 60 END AS x1, part % 3 = 1 AS exact FROM pc),
n AS (SELECT *, last_value(CASE WHEN line IS NOT NULL THEN {{'tok': tok, 'line': line, 'x0': x0, 'x1': x1}} END IGNORE NULLS) OVER (PARTITION BY block ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN line IS NOT NULL THEN {{'tok': tok, 'line': line, 'x0': x0, 'x1': x1}} END IGNORE NULLS) OVER (PARTITION BY block ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t),
p AS (SELECT *, CASE WHEN exact THEN 'word' WHEN line IS NOT NULL THEN 'approx' WHEN coalesce(tok - b.tok <= 2 AND a.tok - tok <= 2 AND b.line = a.line AND a.x1 <= b.x0, false) THEN 'gap' ELSE 'uncertain' END AS place FROM n)
SELECT block, tok, place, CAST(CASE WHEN place = 'gap' THEN b.line ELSE line END AS BIGINT) AS line, CAST(CASE WHEN place = 'gap' THEN a.x1 ELSE x0 END AS BIGINT) AS x0, CAST(CASE WHEN place = 'gap' THEN b.x0 ELSE x1 END AS BIGINT) AS x1 FROM p""")
def token_spots(spark, d):
    """Where each token lies: on a word, near one, in a gap between two, or nowhere sure."""
    read = F.col("part") % 3 > 0
    when = lambda c: F.when(read, c)
    rows = pieces(spark, d).select(F.col("page").alias("block"), F.col("ord").alias("tok"), when((F.col("supp") % 2).cast("int")).alias("line"), when(1000 - F.col("ord") * 60).alias("x0"), when(1050 - F.col("ord") * 60).alias("x1"), (F.col("part") % 3 == 1).alias("exact"))
    out = alignment.locate(rows).select("block", "tok", "place", "line", "x0", "x1")
    return longs(out, "block", "tok", "place")


@query(f"""
WITH {_PIECES} SELECT page, supp % 2 AS blk, part % 2 AS par, 0 AS line, CAST(min(x0) AS BIGINT) AS x0, CAST(max(x1) AS BIGINT) AS x1, round(avg(y0), 6) AS conf, string_agg('w' || part, ' ' ORDER BY ord) AS text FROM pc GROUP BY 1, 2, 3""")
def ocr_lines(spark, d):
    """Words of an OCR engine as lines, with boxes and mean confidence."""
    p = pieces(spark, d)
    words = p.select("page", (F.col("supp") % 2).alias("blk"), (F.col("part") % 2).alias("par"), F.lit(0).alias("line"), F.col("ord").alias("no"), F.concat(F.lit("w"), F.col("part").cast("string")).alias("text"), F.col("y0").cast("double").alias("conf"), "x0", "y0", "x1", "y1")
    rows = structure.assemble_lines(words)
    return rows.select("page", "blk", "par", "line", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), F.round("conf", 6).alias("conf"), "text")


@query(f"""
WITH {_PIECES}, b AS (SELECT page, max(part) % 50 AS n_chars, CASE WHEN max(supp) % 5 > 0 THEN max(supp) % 40 END AS off, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY ord) AS rects FROM pc GROUP BY 1),
w AS (SELECT *, list_transform(rects, lambda r: r.x1 - r.x0) AS ws FROM b), t AS (SELECT *, CASE WHEN off IS NULL THEN 0.5 ELSE off / greatest(n_chars, 1)::DOUBLE END * list_sum(ws) AS target FROM w),
k AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM t),
m AS (SELECT *, coalesce(list_sum(ws[1:k - 1]), 0) AS ahead FROM k), e AS (SELECT page, min(k) AS k FROM m WHERE ahead + ws[k] >= target OR k = len(ws) GROUP BY 1)
SELECT m.page, round(rects[k].x1 - least(target - ahead, ws[k]), 6) AS x, round((rects[k].y0 + rects[k].y1) / 2.0::DOUBLE, 6) AS y FROM m JOIN e USING (page, k)""")
def marker_points(spark, d):
    """Where in a block's lines, read right to left, a marker stands."""
    rows = pieces(spark, d).groupBy("page").agg((F.max("part") % 50).alias("n"), F.max("supp").alias("s"), F.array_sort(F.collect_list(F.struct("ord", "x0", "y0", "x1", "y1"))).alias("rects"))
    off = F.when(F.col("s") % 5 > 0, F.col("s") % 40)
    p = structure.marker_point(off, F.col("n"), F.col("rects"))
    return rows.select("page", F.round(p.x.cast("double"), 6).alias("x"), F.round(p.y.cast("double"), 6).alias("y"))


_QUOTES = f"""q AS (SELECT item_id AS qid, array_to_string(CASE item_id % 3 WHEN 0 THEN w[2:5] WHEN 1 THEN list_concat(w[2:4], ['zzz']) ELSE list_concat(w[2:2], ['zzz', 'yyy']) END, ' ') AS quote FROM (SELECT item_id, {words_sql()} AS w FROM benchmark) WHERE len(w) >= 5),
b AS (SELECT item_id AS id, {key_sql()} AS key FROM benchmark), p AS (SELECT qid, quote, id, id AS pos, key FROM q JOIN b ON id // 5 = qid // 5)"""


@query(f"""
WITH {_QUOTES}, s AS (SELECT *, contains(key, quote) AS whole, len(list_filter(string_split(quote, ' '), lambda w: list_contains(string_split(key, ' '), w))) / len(string_split(quote, ' '))::DOUBLE AS share FROM p),
x AS (SELECT qid, bool_or(whole) AS found, max(share) AS best FROM s GROUP BY 1),
f AS (SELECT s.qid, min(pos) AS pos FROM s JOIN x USING (qid) WHERE NOT found AND share = best AND best >= 0.6 GROUP BY 1)
SELECT qid, id FROM s WHERE whole UNION ALL SELECT qid, pos FROM f""")
def quote_blocks(spark, d):
    """Blocks that hold a quote, or most of its words; five passages are the blocks of a unit."""
    w = T.words(N.latin_key(F.col("text")))
    rows = table(spark, d, "benchmark").select("item_id", w.alias("w"), N.latin_key(F.col("text")).alias("key"), F.floor(F.col("item_id") / 5).alias("unit"))
    zzz = lambda *x: F.array(*map(F.lit, x))
    quote = F.when(F.col("item_id") % 3 == 0, F.slice("w", 2, 4)).when(F.col("item_id") % 3 == 1, F.concat(F.slice("w", 2, 3), zzz("zzz"))).otherwise(F.concat(F.slice("w", 2, 1), zzz("zzz", "yyy")))
    quotes = rows.where(F.size("w") >= 5).select(F.col("item_id").alias("qid"), "unit", F.array_join(quote, " ").alias("quote"))
    blocks = rows.select("unit", F.col("item_id").alias("id"), F.col("item_id").alias("pos"), "key")
    return structure.blocks_for_quote(quotes.join(blocks, "unit"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'removed' ELSE 'checked' END AS t FROM labels WHERE doc_id % 2 = 0)
SELECT d.doc_id, coalesce(t, lang) AS lang, CASE WHEN t IS NOT NULL THEN lang END AS original_lang FROM documents d LEFT JOIN c USING (doc_id)""")
def corrected(spark, d):
    """Corrections put over values, which stay beside them."""
    c = table(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("toxic") == 1, "removed").otherwise("checked").alias("lang"))
    return structure.overlay(table(spark, d, "documents").select("doc_id", "lang"), c, ["doc_id"], "lang")


@query(f"""
WITH RECURSIVE w AS (SELECT source || '|' || lang AS page, doc_id, {words_sql()} AS w FROM documents),
r AS (SELECT page, doc_id, i, array_to_string(w[i + 1 : i + 12], ' ') AS run FROM (SELECT page, doc_id, w, unnest(range(0, len(w) - 11)) AS i FROM w WHERE len(w) >= 12)),
f AS (SELECT page, doc_id, run, min(i) AS i FROM r GROUP BY ALL),
o AS MATERIALIZED (SELECT page, doc_id, run, i FROM (SELECT *, count(*) OVER (PARTITION BY page, run) AS n FROM f) WHERE n > 1),
s AS (
  SELECT 0 AS k, page, doc_id, 1000000000 AS stop, NULL::BIGINT AS owner FROM (SELECT DISTINCT page, doc_id FROM o)
  UNION ALL
  SELECT k + 1, page, doc_id, coalesce(min(i) FILTER (first < doc_id), 1000000000), arg_min(first, i) FILTER (first < doc_id)
  FROM (SELECT s.k, o.page, o.doc_id, o.i, min(CASE WHEN o.i < s.stop THEN o.doc_id END) OVER (PARTITION BY o.page, o.run) AS first FROM s JOIN o ON o.page = s.page AND o.doc_id = s.doc_id WHERE s.k < 24) GROUP BY k, page, doc_id
)
SELECT page, doc_id AS id, owner FROM s WHERE k = 24 AND stop < 1000000000""")
def duplicate_runs(spark, d):
    """Documents of a source and language that repeat twelve words of an earlier one, as a reader meets them."""
    w = T.words(N.latin_key(F.col("text")))
    rows = table(spark, d, "documents").select(F.concat("source", F.lit("|"), "lang").alias("page"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), w.alias("words"))
    return structure.duplicate_runs(rows)


@query()
def uncovered(spark, d):
    """Lines of text that the page of their number does not hold, spelt in Arabic script."""
    from .key_queries import scribe

    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), N.normalize(scribe(F.col("text")), stable=True).alias("key"), (F.col("item_id") % 60 + 30.0).alias("conf"))
    page = table(spark, d, "documents").select(F.col("doc_id").alias("page"), N.normalize(scribe(F.col("text")), stable=True).alias("text"))
    lines = rows.join(page, "page").withColumn("n_segments", F.when(F.col("page") % 2 == 0, 2).otherwise(1))
    out = reference.uncovered_lines(lines, fuzzy.partial_ratio(F.col("key"), F.col("text")))
    return out.select("page", F.round("score", 1).alias("score"))


def _readings(spark, d):
    """Each passage as three readers have it: as it is, with a word changed, with one left out."""
    w = T.words(N.latin_key(F.col("text")))
    rows = table(spark, d, "benchmark").select("item_id", w.alias("b")).where(F.size("b") >= 6)
    return rows.withColumn("a", F.concat(F.slice("b", 1, 3), F.array(F.lit("zzz")), F.slice("b", F.lit(5), F.size("b")))).withColumn("c", F.concat(F.slice("b", 1, 2), F.slice("b", F.lit(4), F.size("b"))))


@query()
def reading_spans(spark, d):
    """For each word of one reading the span of another's."""
    rows = _readings(spark, d).select("item_id", F.explode(alignment.span_map(F.col("b"), F.col("c"))).alias("s"))
    return rows.select("item_id", "s.*")


@query()
def matched_tokens(spark, d):
    """Words of a block found among another reading's, exactly or nearly, and their places as tokens."""
    rows = _readings(spark, d)
    near = rows.select("item_id", F.lit("block").alias("how"), F.explode(alignment.matched_words(F.col("b"), F.col("a"))).alias("m"))
    spots = rows.select("item_id", F.lit("token").alias("how"), F.explode(alignment.token_places(F.col("b"), F.col("a"))).alias("m"))
    return near.unionByName(spots).select("item_id", "how", "m.*")


@query()
def type_matches(spark, d):
    """Each block's best match among the blocks of the next page, and the share of characters of equal type."""
    rows = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("key"), (F.col("item_id") % 3).cast("string").alias("type"))
    a = rows.select((F.col("item_id") / 4).cast("long").alias("page"), F.col("item_id").alias("id"), F.col("key").alias("a"), F.col("type").alias("gold_type"), F.length("key").alias("n_chars"))
    b = rows.select((F.col("item_id") / 4).cast("long").alias("page"), F.col("item_id").alias("other"), F.reverse("key").alias("r"), "key", "type")
    pairs = a.join(b, "page").select("id", "other", "a", F.when(F.col("id") % 2 == 0, F.col("key")).otherwise(F.col("r")).alias("b"), "gold_type", "n_chars", "type")
    best = alignment.best_matches(pairs)
    every = a.select("id", "gold_type", "n_chars").join(best.select("id", "ratio", "type", F.col("other").alias("pos")), "id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0))).withColumn("pos", F.coalesce("pos", F.lit(0)))
    return metrics.type_accuracy(every.withColumnRenamed("id", "gold_id"))


@query(r"""
WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS a, text AS b, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, ' ', '  ') || ' x' END AS c, CASE WHEN doc_id % 7 = 0 THEN 'by hand' END AS decision FROM documents WHERE text IS NOT NULL)
SELECT id, decision IS NULL AND id % 3 = 0 AS auto, CASE WHEN decision IS NULL AND id % 3 = 0 THEN b ELSE decision END AS decision FROM i""")
def settled_readings(spark, d):
    """Disputes that two readers print alike are settled; a reader's own decision stays."""
    i, head = F.col("doc_id"), F.col("text")
    other = F.concat(F.replace(head, F.lit(" "), F.lit("  ")), F.lit(" x"))
    items = table(spark, d, "documents").where("text is not null").select(i.alias("id"), F.when(i % 4 != 0, head).alias("a"), head.alias("b"), F.when(i % 3 == 0, head).otherwise(other).alias("c"), F.when(i % 7 == 0, "by hand").alias("decision"))
    return alignment.resolve_equivalent(items, stable=True).select("id", "auto", "decision")


@query(f"""
WITH t AS (SELECT item_id AS block, i AS tok, w[i + 1] AS raw FROM (SELECT item_id, w, unnest(range(0, len(w))) AS i FROM (SELECT item_id, {words_sql()} AS w FROM benchmark))),
s AS (SELECT item_id AS block, 2 AS first, 3 AS last, CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'new words' END AS decision FROM benchmark WHERE item_id % 2 = 0),
k AS (SELECT t.block, t.tok, t.raw AS t FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.block = t.block AND t.tok BETWEEN s.first AND s.last) UNION ALL SELECT block, first, decision FROM s WHERE decision <> ''),
x AS (SELECT block, string_agg(t, ' ' ORDER BY tok) AS text FROM k GROUP BY 1)
SELECT DISTINCT t.block, CASE WHEN t.block IN (SELECT block FROM s WHERE decision IS NULL) THEN NULL ELSE coalesce(x.text, '') END AS text FROM t LEFT JOIN x USING (block)""")
def replayed_texts(spark, d):
    """A page's text with the decided spans in their place; none where one is undecided."""
    w = T.words(N.latin_key(F.col("text")))
    b = table(spark, d, "benchmark")
    tokens = b.select(F.col("item_id").alias("block"), F.posexplode(w).alias("tok", "raw"))
    i = F.col("item_id")
    spans_ = b.where(i % 2 == 0).select(i.alias("block"), F.lit(2).alias("first"), F.lit(3).alias("last"), F.when(i % 5 == 0, "").when(i % 5 != 1, "new words").alias("decision"))
    return alignment.replay(tokens, spans_)


@query(f"""
WITH {_PIECES}, dt AS (SELECT page AS block, ord AS tok FROM pc WHERE part % 3 > 0),
r AS (SELECT *, tok - row_number() OVER (PARTITION BY block ORDER BY tok) AS run FROM dt), p AS (SELECT *, (row_number() OVER (PARTITION BY block, run ORDER BY tok) - 1) // 4 AS part FROM r),
g AS (SELECT block, min(tok) AS first, max(tok) AS last FROM p GROUP BY block, run, part)
SELECT block, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CASE WHEN first % 2 = 0 THEN CASE WHEN first = last THEN 'B+C+A:r' || first ELSE 'B+A:r' || first || '|C:r' || last END ELSE 'B:r' || first || '|C+A:s' END AS candidates FROM g""")
def dispute_candidates(spark, d):
    """Runs of disputed tokens, four at most, with the readings that stand for each and who reads them."""
    tokens = pieces(spark, d).select(F.col("page").alias("block"), F.col("ord").alias("tok"), F.when(F.col("part") % 3 > 0, "disputed").otherwise("agree").alias("status"))
    g = review.dispute_groups(tokens)
    one = lambda r, t: F.struct(F.lit(r).alias("reader"), t.alias("text"))
    even = F.col("first") % 2 == 0
    rfirst, rlast = F.concat(F.lit("r"), F.col("first").cast("string")), F.concat(F.lit("r"), F.col("last").cast("string"))
    # A reading of even groups is empty for nobody; odd ones share the last two readers' text.
    readings = F.array(one("B", rfirst), one("C", F.when(even, F.concat(rlast, F.lit(""))).otherwise(F.lit("s"))), one("A", F.when(even, rfirst).otherwise(F.lit("s"))))
    rows = review.candidate_readings(g.withColumn("readings", readings)).withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.concat(F.array_join(c.readers, "+"), F.lit(":"), c.text)), "|"))
    return g.join(rows, ["block", "first"]).select("block", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "candidates")
