"""Queries on units, chunks, views and passages. Conversations stand for books, their turns for blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.constants import CHAPTER_WORD
from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import chunking, fuzzy, gates, reference, retrieval
from folioscope.sources.io import table

from .registry import registry, words_sql
from .retrieval_queries import BM25, EVERY, bm25_sql, dense_list, index, lexical, question_terms, texts, top_sql

QUERIES, ORACLES, query = registry()

#: Turns as blocks: book, pos, block_id, page_id, type, role, text, confidence.
_BLOCKS = """bk AS (SELECT conv_id AS book, turn AS pos, conv_id || '-' || turn AS block_id, conv_id || '/' || turn // 4 AS page_id,
  CASE WHEN role = 'system' THEN 'heading' WHEN turn % 11 = 7 THEN 'footnote' WHEN turn % 7 = 5 THEN 'page_number' WHEN role = 'user' THEN 'body' ELSE 'hadith' END AS type,
  CASE WHEN turn % 9 = 4 THEN 'editor' ELSE 'matn' END AS role, coalesce(text, '') AS text, round(0.5 + (length(coalesce(text, '')) % 50) / 100.0::DOUBLE, 2) AS conf FROM conversations)"""


def blocks(spark, d):
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "system", "heading").when(turn % 11 == 7, "footnote").when(turn % 7 == 5, "page_number").when(F.col("role") == "user", "body").otherwise("hadith")
    book = F.col("conv_id").cast("string")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("book"), turn.alias("pos"), F.concat(book, F.lit("-"), turn.cast("string")).alias("block_id"), F.concat(book, F.lit("/"), F.floor(turn / 4).cast("string")).alias("page_id"), kind.alias("type"),
        F.when(turn % 9 == 4, "editor").otherwise("matn").alias("author_role"), text.alias("text"), F.round(0.5 + (F.length(text) % 50) / F.lit(100.0), 2).alias("confidence"), (turn % 5 == 3).alias("continues_from_prev"),
    )


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, s, len(s) AS n, list_sum(s) + len(s) - 1 AS total FROM d),
-- (first, last, sum): a window grows by one block a step, then is kept and the next one begins.
g AS (
  SELECT doc_id, s, n, 1 AS first, 0 AS last, CAST(0 AS HUGEINT) AS size, 0 AS kept FROM t WHERE total > 2500
  UNION ALL
  SELECT doc_id, s, n, CASE WHEN kept = 0 THEN first ELSE greatest(first + 1, last) END,
    CASE WHEN kept = 0 THEN CASE WHEN last < n AND (size = 0 OR size + s[last + 1] <= 1800) THEN last + 1 ELSE last END ELSE greatest(first + 1, last) - 1 END,
    CASE WHEN kept = 0 THEN CASE WHEN last < n AND (size = 0 OR size + s[last + 1] <= 1800) THEN size + s[last + 1] ELSE size END ELSE 0 END,
    CASE WHEN kept = 0 THEN CASE WHEN last < n AND (size = 0 OR size + s[last + 1] <= 1800) THEN 0 ELSE 1 END ELSE 0 END
  FROM g WHERE NOT (kept = 1 AND last >= n)
), w AS (SELECT doc_id, first, last, size FROM g WHERE kept = 1 UNION ALL SELECT doc_id, 1, n, list_sum(s) FROM t WHERE total <= 2500)
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS BIGINT) AS window_no, CAST(first - 1 AS BIGINT) AS first, CAST(last - 1 AS BIGINT) AS last, CAST(size + last - first AS BIGINT) AS n_chars FROM w""")
def search_windows(spark, d):
    """Windows of whole lines of the long documents."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("blocks"))
    rows = chunking.search_windows(docs, "doc_id")
    return rows.select("id", F.col("window").cast("long").alias("window_no"), *[F.col(c).cast("long").alias(c) for c in ("first", "last", "n_chars")])


def chunks(spark, d):
    b = blocks(spark, d)
    attached = F.when((F.col("pos") % 13 == 8), F.lit("x"))
    return chunking.structural_chunks(b.withColumns({"attached_to": attached, "ends": T.ends_sentence(F.col("text")), "starts": (F.col("type") == "body") & (F.length("text") % 3 == 0)}))


#: The chunks as one walk over each book: (now, main, size, ended, chapter) after every block.
_CHUNKED = rf"""{_BLOCKS},
rel AS (SELECT book, pos, block_id, text, type = 'heading' AS h, type <> 'heading' AND (role = 'editor' OR type = 'editor_commentary') AS e, pos % 5 = 3 AS goes, type = 'body' AND length(text) % 3 = 0 AS starts,
  regexp_matches(rtrim(regexp_replace(rtrim(text), '(\s*\(\s*[0-9]{{1,3}}\s*\))+\s*$', '')), '[.؟!»:؛*]$') AS ends, row_number() OVER (PARTITION BY book ORDER BY pos) AS i
  FROM bk WHERE type NOT IN ('page_header', 'page_number', 'footnote') AND pos % 13 <> 8),
walk AS (
  SELECT book, 0::BIGINT AS i, 'none' AS now, -1::BIGINT AS main, -1::BIGINT AS cur, 0::BIGINT AS made, 0::BIGINT AS size, false AS ended, NULL::VARCHAR AS chapter, NULL::VARCHAR AS mchapter, NULL::VARCHAR AS cchapter FROM (SELECT DISTINCT book FROM rel)
  UNION ALL
  SELECT book, i, CASE WHEN h THEN 'none' WHEN e THEN 'editor' ELSE 'main' END, CASE WHEN NOT h AND NOT e AND fresh THEN made ELSE main END, CASE WHEN h THEN -1 WHEN fresh THEN made WHEN e THEN cur ELSE main END, CASE WHEN fresh THEN made + 1 ELSE made END,
    CASE WHEN h OR e THEN size WHEN fresh THEN length(text) ELSE size + length(text) END, CASE WHEN h OR e THEN ended ELSE ends END, chap, CASE WHEN NOT h AND NOT e AND fresh THEN chap ELSE mchapter END, CASE WHEN h THEN NULL WHEN fresh THEN chap WHEN e THEN cchapter ELSE mchapter END
  FROM (
    SELECT w.*, r.h, r.e, r.text, r.ends, r.i AS next_i,
      CASE WHEN r.h AND (contains(r.text, '{CHAPTER_WORD}') OR coalesce(chapter, '') = '') THEN trim(regexp_replace(r.text, '\s+', ' ', 'g')) ELSE chapter END AS chap,
      CASE WHEN r.h THEN false WHEN r.e THEN now <> 'editor' WHEN now = 'editor' AND r.goes AND NOT r.starts AND main >= 0 THEN false
           ELSE now <> 'main' OR (r.starts AND NOT r.goes) OR (size > 2200 AND ended AND NOT r.goes) END AS fresh
    FROM walk w JOIN rel r ON r.book = w.book AND r.i = w.i + 1
  ) AS t(book, j, now, main, cur, made, size, ended, chapter, mchapter, cchapter, h, e, text, ends, i, chap, fresh)
),
ch AS (SELECT r.book, r.block_id, r.pos, r.text, w.cur AS chunk, CASE WHEN r.e THEN 'editor_commentary' ELSE 'matn' END AS kind, w.cchapter AS chapter, CASE WHEN r.e AND w.main >= 0 THEN w.main END AS commentary_on
  FROM rel r JOIN walk w ON w.book = r.book AND w.i = r.i WHERE NOT r.h)"""


@query(f"WITH RECURSIVE {_CHUNKED} SELECT book, block_id, chunk, kind, chapter, commentary_on FROM ch")
def structural_chunks(spark, d):
    """Chunks of a book that follow its structure."""
    return chunks(spark, d)


@query(rf"""
WITH RECURSIVE {_CHUNKED},
fe AS (SELECT book, chunk, min(pos) AS pos, min(commentary_on) AS before FROM ch WHERE kind = 'editor_commentary' GROUP BY 1, 2),
ln AS (SELECT b.book, b.page_id, b.pos, book || '-' || (pos - 2) AS anchor FROM bk b WHERE type = 'footnote'),
st AS (SELECT book, page_id, pos FROM bk WHERE NOT (type IN ('footnote', 'page_number', 'page_header', 'poetry') OR role = 'editor')),
nr AS (SELECT fe.book, fe.chunk, fe.before, arg_max(ln.anchor, ln.pos) AS anchor FROM fe JOIN bk p ON p.book = fe.book AND p.pos = fe.pos
  LEFT JOIN ln ON ln.book = fe.book AND ln.page_id = p.page_id AND ln.pos < fe.pos AND NOT EXISTS (SELECT 1 FROM st WHERE st.book = fe.book AND st.page_id = p.page_id AND st.pos > ln.pos AND st.pos < fe.pos) GROUP BY 1, 2, 3),
tg AS (SELECT nr.book, nr.chunk, coalesce(m.chunk, nr.before) AS target FROM nr LEFT JOIN ch m ON m.book = nr.book AND m.block_id = nr.anchor AND m.kind = 'matn'),
hd AS (SELECT book, chunk, arg_min(text, pos) AS head FROM ch WHERE kind = 'matn' GROUP BY 1, 2)
SELECT tg.book, tg.chunk, tg.target, array_to_string(list_filter(regexp_split_to_array(head, '\s+'), lambda x: x <> '')[1:14], ' ') AS about FROM tg LEFT JOIN hd ON hd.book = tg.book AND hd.chunk = tg.target""")
def commentary(spark, d):
    """What the editor's chunks comment on."""
    b = blocks(spark, d)
    links = b.where("type = 'footnote'").select(F.col("block_id").alias("note_id"), F.concat(F.col("book").cast("string"), F.lit("-"), (F.col("pos") - 2).cast("string")).alias("anchor"))
    return chunking.attach_commentary(chunks(spark, d), b.withColumn("pos", F.col("pos")), links)


#: A chunk is four turns here, so that SQL can say the same.
_CHUNKS = f"{_BLOCKS}, ck AS (SELECT *, pos // 4 AS chunk FROM bk WHERE type NOT IN ('heading', 'page_number', 'footnote')), nt AS (SELECT book || '-' || (pos - 2) AS anchor, block_id AS note_id, text FROM bk WHERE type = 'footnote')"


def _four(spark, d):
    b = blocks(spark, d)
    own = b.where(~F.col("type").isin("heading", "page_number", "footnote"))
    c = own.select("book", "block_id", F.floor(F.col("pos") / 4).alias("chunk"), F.lit("matn").alias("kind"), F.lit("part").alias("chapter"))
    notes = b.where("type = 'footnote'").select(F.concat(F.col("book").cast("string"), F.lit("-"), (F.col("pos") - 2).cast("string")).alias("anchor"), F.col("block_id").alias("note_id"), "text")
    return b, c, notes


@query(rf"""
WITH RECURSIVE {_CHUNKED}, nt AS (SELECT book || '-' || (pos - 2) AS anchor, block_id AS note_id, text FROM bk WHERE type = 'footnote'),
n AS (SELECT anchor, string_agg(text, ' ' ORDER BY note_id) AS notes, count(*) AS k FROM nt GROUP BY 1),
x AS (SELECT ch.*, bk.page_id, bk.conf, n.notes, n.k, CASE WHEN ch.pos % 3 = 1 THEN 'u' || ch.pos END AS unit FROM ch JOIN bk USING (block_id) LEFT JOIN n ON n.anchor = ch.block_id)
SELECT book, chunk, kind, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest, string_agg(block_id, ',' ORDER BY pos) AS block_ids, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_notes, coalesce(string_agg(notes, ' ' ORDER BY pos), '') AS notes,
  CAST(len(list_filter(regexp_split_to_array(string_agg(text, chr(10) ORDER BY pos), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, min(conf) AS confidence, CASE WHEN coalesce(chapter, '') = '' THEN 'the book' ELSE 'the book › ' || chapter END AS crumbs,
  coalesce(array_to_string(list_sort(list_distinct(list(unit) FILTER (unit IS NOT NULL))), ','), '') AS unit_ids
FROM x GROUP BY book, chunk, kind, chapter""")
def chunk_texts(spark, d):
    """Structure-following chunks with their texts, notes, pages, units and least confidence."""
    b = blocks(spark, d)
    notes = b.where("type = 'footnote'").select(F.concat(F.col("book").cast("string"), F.lit("-"), (F.col("pos") - 2).cast("string")).alias("anchor"), F.col("block_id").alias("note_id"), "text")
    units = b.where("pos % 3 = 1").select("block_id", F.concat(F.lit("u"), F.col("pos").cast("string")).alias("unit_id"))
    rows = chunking.materialise(chunks(spark, d), b, notes, units, "the book")
    return rows.select("book", "chunk", "kind", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("block_ids", ",").alias("block_ids"), F.size("pages").cast("long").alias("n_pages"), F.size("note_ids").cast("long").alias("n_notes"), "notes", F.col("n_words").cast("long").alias("n_words"), "confidence", F.array_join("crumbs", " › ").alias("crumbs"), F.array_join("unit_ids", ",").alias("unit_ids"))


@query(f"""
WITH {_BLOCKS}, u AS (SELECT book, pos // 5 AS unit, min(pos) AS first, nullif(string_agg(CASE WHEN type = 'hadith' AND pos % 3 = 1 THEN text END, ' ' ORDER BY pos), '') AS wording, max(CASE WHEN pos % 17 = 3 THEN 'printed' END) AS printed FROM bk GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY first) - 1 AS no FROM u)
SELECT book, CAST(unit AS BIGINT) AS unit, CAST(no AS BIGINT) AS no, wording IS NOT NULL AS worded FROM n WHERE wording IS NOT NULL OR printed IS NOT NULL""")
def unit_numbers(spark, d):
    """Units with a wording or an attribution, numbered before the others go."""
    b = blocks(spark, d)
    text = F.when((F.col("type") == "hadith") & (F.col("pos") % 3 == 1) & (F.col("text") != ""), F.col("text"))
    rows = b.groupBy("book", F.floor(F.col("pos") / 5).alias("unit")).agg(F.min("pos").alias("first"), F.max(text).alias("wording"), F.max(F.when(F.col("pos") % 17 == 3, "printed")).alias("printed"))
    out = reference.unit_verdicts(rows)
    return out.select("book", F.col("unit").cast("long").alias("unit"), F.col("no").cast("long").alias("no"), F.col("wording").isNotNull().alias("worded"))


@query("""
WITH g AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'in_sahihayn' ELSE 'other' END AS printed, CASE WHEN o_custkey % 3 > 0 THEN 'ext' || o_custkey % 4 END AS ext, CASE o_custkey % 7 WHEN 0 THEN 'auto' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'pending' END AS state, CASE WHEN o_orderkey % 4 = 1 THEN 'man' END AS man, CASE WHEN o_orderkey % 8 > 3 THEN 'url' END AS url FROM orders),
s AS (SELECT *, CASE WHEN printed = 'in_sahihayn' THEN 'in_sahihayn' WHEN ext IS NOT NULL AND coalesce(state IN ('auto', 'confirmed'), false) THEN 'external' WHEN ext IS NOT NULL AND (state IS NULL OR state = 'pending') THEN 'external_pending' WHEN man IS NOT NULL AND url IS NOT NULL THEN 'manual' ELSE 'unverified' END AS status FROM g)
SELECT id, status, CASE status WHEN 'in_sahihayn' THEN printed WHEN 'external' THEN ext WHEN 'external_pending' THEN ext WHEN 'manual' THEN man ELSE 'not known' END AS grade FROM s""")
def gradings(spark, d):
    """Which of several gradings counts, and the view of it."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(c % 7 == 0, "auto").when(c % 7 == 1, "confirmed").when(c % 7 == 2, "rejected").when(c % 7 == 3, "pending")
    status, grade = reference.grading(F.when(o % 5 == 0, "in_sahihayn").otherwise("other"), F.when(c % 3 > 0, F.concat(F.lit("ext"), (c % 4).cast("string"))), state, F.when(o % 4 == 1, "man"), F.when(o % 8 > 3, "url"))
    rows = table(spark, d, "orders").select(o.alias("unit_id"), F.lit("n").alias("narrator"), status.alias("status"), grade.alias("grade"), F.lit("s").alias("source"))
    return reference.graded_view(rows, "not known").select(F.col("unit_id").alias("id"), "status", "grade")


@query("""
SELECT o_orderkey AS id, coalesce(o_custkey % 2 = 0, false) AND greatest(o_custkey % 101, o_orderkey % 97) >= 80 AS auto, round(greatest(o_custkey % 101, o_orderkey % 97)::DOUBLE, 1) AS score FROM orders""")
def external_decisions(spark, d):
    """Is an external entry the same report?"""
    auto, score = gates.external_decision(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 101).cast("double"), (F.col("o_orderkey") % 97).cast("double"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), auto.alias("auto"), score.alias("score"))


@query()
def external_matches(spark, d):
    """Passages that a title stands in, with its typos: no pair is lost, and the larger of two scores confirms."""
    rows = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("key"))
    whole = F.array_join(F.slice(F.split("key", " "), 2, 5), " ")
    title = F.when(F.col("item_id") % 3 == 0, whole).otherwise(F.concat(F.substring(whole, 1, 4), F.lit("q"), F.substring(whole, F.lit(6), F.length(whole))))
    entries = rows.select(F.col("item_id").alias("ext_id"), title.alias("title_key"), F.col("key").alias("text_key"))
    return fuzzy.match_external(rows.select(F.col("item_id").alias("id"), "key"), entries).select("id", "ext_id", "place", F.round("score", 1).alias("score"), F.round("sure", 1).alias("sure"))


@query(f"""
WITH {_BLOCKS}, h AS (SELECT book AS qid, block_id AS id, pos + 1 AS rank FROM bk WHERE pos % 6 < 2),
t AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM h),
o AS (SELECT * FROM (VALUES (0, -1), (1, 1), (2, -2), (3, 2)) v(i, dd)),
n AS (SELECT t.qid, v.block_id AS id, min(t.rank * 10 + o.i) AS k FROM t JOIN bk u ON u.block_id = t.id, o JOIN bk v ON v.book = u.book AND v.type = u.type AND v.pos = u.pos + o.dd
  WHERE t.rank <= 2 AND v.page_id = u.page_id AND NOT EXISTS (SELECT 1 FROM t x WHERE x.qid = t.qid AND x.id = v.block_id) GROUP BY 1, 2)
SELECT qid, id, CAST(place AS BIGINT) AS place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS place FROM n) WHERE place <= 3""")
def page_neighbours(spark, d):
    """Neighbours of a question's first two hits that share a page and a type with them."""
    b = blocks(spark, d)
    w = Window.partitionBy("book").orderBy("pos")
    hits = b.where("pos % 6 < 2").select(F.col("book").alias("qid"), F.col("block_id").alias("id"), F.row_number().over(w).alias("rank"))
    units = b.select(F.col("block_id").alias("id"), F.col("book").alias("grp"), F.col("type").alias("kind"), "pos", F.array("page_id").alias("pages"))
    return chunking.neighbours(hits, units).withColumn("place", F.col("place").cast("long"))


@query(f"""
WITH {_BLOCKS}, i AS (
  SELECT page_id, block_id, 'low confidence' AS reason, conf AS confidence FROM bk WHERE conf < 0.75
  UNION ALL SELECT DISTINCT page_id, NULL, 'page flag', NULL::DOUBLE FROM bk WHERE type = 'footnote'),
r AS (SELECT DISTINCT page_id, 'PAGE' AS block FROM bk WHERE type = 'footnote' AND book % 2 = 0 UNION SELECT page_id, block_id FROM bk WHERE pos % 3 = 0),
b AS (SELECT page_id, count(*) AS n_blocks FROM bk GROUP BY 1)
SELECT i.page_id, i.block_id, i.reason, i.confidence, CASE WHEN i.block_id IS NULL THEN n_blocks END AS regions FROM i JOIN b USING (page_id) LEFT JOIN r ON r.page_id = i.page_id AND r.block = coalesce(i.block_id, 'PAGE') WHERE r.block IS NULL""")
def open_reviews(spark, d):
    """Open items of the review queue: uncertain blocks and flagged pages, these with their page's regions."""
    b = blocks(spark, d)
    none = F.array().cast("array<string>")
    queue = gates.review_queue(b.withColumn("reasons", none)).select("page_id", "block_id", "reason", "confidence")
    flags = b.where("type = 'footnote'").select("page_id").distinct().select("page_id", F.lit(None).cast("string").alias("block_id"), F.lit("page flag").alias("reason"), F.lit(None).cast("double").alias("confidence"))
    given = b.where("type = 'footnote' and book % 2 = 0").select("page_id", F.lit("PAGE").alias("block")).union(b.where("pos % 3 = 0").select("page_id", "block_id")).distinct()
    resolutions = given.select("page_id", "block", F.lit("r").alias("by"), F.lit("n").alias("note"), F.lit(0).alias("at"))
    items = gates.resolve(queue.unionByName(flags).withColumnRenamed("block_id", "block"), resolutions, page="page_id").where("resolution is null").withColumnRenamed("block", "block_id")
    regions = b.groupBy("page_id").agg(F.count("*").alias("n"))
    return items.join(regions, "page_id").select("page_id", "block_id", "reason", "confidence", F.when(F.col("block_id").isNull(), F.col("n")).alias("regions"))


@query(f"""
WITH {_CHUNKS}, h AS (SELECT book AS qid, chunk, CAST(row_number() OVER (PARTITION BY book ORDER BY chunk DESC) AS BIGINT) AS rank FROM (SELECT DISTINCT book, chunk FROM ck)),
n AS (SELECT nt.anchor, nt.note_id, nt.text || ' ' || 'att' AS t FROM nt),
v AS (SELECT block_id, 'v' || length(text) % 9 AS ref FROM bk WHERE length(text) % 4 = 0)
SELECT h.qid, h.rank, h.qid || 'c' || h.chunk AS id, string_agg(ck.text, '|' ORDER BY pos) AS parts,
  coalesce((SELECT string_agg(n.t, '|' ORDER BY c.pos, n.note_id) FROM ck c JOIN n ON n.anchor = c.block_id WHERE c.book = h.qid AND c.chunk = h.chunk), '') AS notes,
  coalesce((SELECT string_agg(ref, '|' ORDER BY ref) FROM (SELECT DISTINCT v.ref FROM ck c JOIN v ON v.block_id = c.block_id WHERE c.book = h.qid AND c.chunk = h.chunk UNION SELECT v.ref FROM ck c JOIN n ON n.anchor = c.block_id JOIN v ON v.block_id = n.note_id WHERE c.book = h.qid AND c.chunk = h.chunk)), '') AS refs,
  string_agg(DISTINCT page_id, '|' ORDER BY page_id) AS pages
FROM h JOIN ck ON ck.book = h.qid AND ck.chunk = h.chunk WHERE h.rank <= 3 GROUP BY h.qid, h.rank, h.chunk""")
def passage_views(spark, d):
    """Whole passages of hits: blocks in order, notes with attached text, verses of both, pages."""
    b, c, notes = _four(spark, d)
    rows = c.join(b.select("block_id", "pos"), "block_id").groupBy("book", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id"))), lambda s: s.block_id).alias("block_ids"))
    name = F.concat(F.col("book").cast("string"), F.lit("c"), F.col("chunk").cast("string"))
    units = rows.select(name.alias("id"), F.lit("matn").alias("kind"), F.array(F.lit("book")).alias("crumbs"), "block_ids")
    w = Window.partitionBy("book").orderBy(F.desc("chunk"))
    hits = rows.select(F.col("book").alias("qid"), name.alias("id"), F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")
    full = notes.withColumn("attached", F.array(F.lit("att")))
    marks = b.where(F.length("text") % 4 == 0).select("block_id", F.concat(F.lit("v"), (F.length("text") % 9).cast("string")).alias("ref"))
    pages = b.select("page_id", F.col("page_id").alias("printed")).distinct()
    out = reference.passages(hits, units, b.select("block_id", "page_id", "text"), full, marks, pages)
    return out.select("qid", "rank", "id", *[F.array_join(x, "|").alias(y) for x, y in (("parts", "parts"), ("notes", "notes"), ("refs", "refs"), ("printed", "pages"))])


@query(f"""
WITH {_BLOCKS}, p AS (SELECT DISTINCT book, pos // 4 AS no, page_id FROM bk), n AS (SELECT *, lag(page_id) OVER (PARTITION BY book ORDER BY no) AS before, lead(page_id) OVER (PARTITION BY book ORDER BY no) AS after FROM p)
SELECT n.book, n.page_id, before, after, string_agg(bk.block_id, ',' ORDER BY pos) AS blocks FROM n JOIN bk ON bk.page_id = n.page_id GROUP BY ALL""")
def page_views(spark, d):
    """Pages with their blocks in order and the pages around them."""
    b = blocks(spark, d)
    pages = b.select("book", F.floor(F.col("pos") / 4).alias("no"), "page_id").distinct()
    out = reference.page_view(pages, b)
    return out.select("book", "page_id", "before", "after", F.array_join(F.transform("blocks", lambda x: x.block_id), ",").alias("blocks"))


@query(f"""
WITH {_BLOCKS}, p AS (SELECT DISTINCT book, pos // 4 AS no, page_id FROM bk), n AS (SELECT book, count(*) AS n_pages, string_agg(page_id, ',' ORDER BY no) AS pages FROM p GROUP BY 1),
x AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS t FROM bk WHERE type <> 'page_number' GROUP BY 1)
SELECT n.book, n_pages, pages, CAST(sum(length(t)) AS BIGINT) AS n_chars, 'Book ' || n.book || '، Author، 2nd ed.، ص ' || n_pages AS citation FROM n JOIN p ON p.book = n.book LEFT JOIN x ON x.page_id = p.page_id GROUP BY ALL""")
def book_views(spark, d):
    """Books with their pages, the length of their texts, and how they are cited."""
    b = blocks(spark, d)
    pages = b.select("book", F.floor(F.col("pos") / 4).alias("no"), "page_id").distinct()
    size = reference.page_text(b).join(pages, "page_id").groupBy("book").agg(F.sum(F.length("text")).alias("n_chars"))
    out = reference.book_view(pages).join(size, "book", "left")
    cite = reference.citation(F.concat(F.lit("Book "), F.col("book").cast("string")), F.lit("Author (d. 1)"), F.lit("2nd ed."), F.col("n_pages"))
    return out.select("book", "n_pages", F.array_join("page_ids", ",").alias("pages"), F.col("n_chars").cast("long").alias("n_chars"), cite.alias("citation"))


@query(f"""
WITH {_BLOCKS} SELECT page_id AS page, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM bk GROUP BY 1""")
def line_views(spark, d):
    """Pages as their lines, in the engine's order."""
    return reference.line_view(blocks(spark, d).select(F.col("page_id").alias("page"), F.col("pos").alias("no"), "text"))


@query("""
SELECT p.page_id AS id, 'baseline' AS kind, md5(html) AS text, CAST(p.page_id % 70 AS VARCHAR) AS page_id, CASE WHEN p.page_id % 70 < 60 THEN p.page_id % 70 + 1 END AS printed FROM pages p""")
def baseline_views(spark, d):
    """Fixed chunks with the number of the page they are on."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(F.encode("html", "UTF-8")).alias("text"), (F.col("page_id") % 70).cast("string").alias("page_id"))
    pages = table(spark, d, "pages").select((F.col("page_id") % 70).alias("n")).distinct().where("n < 60").select(F.col("n").cast("string").alias("page_id"), (F.col("n") + 1).alias("printed"))
    return reference.baseline_view(rows, pages)


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS length FROM n""")
def unit_vectors(spark, d):
    """Vectors divided by their length."""
    u = retrieval.unit(F.transform(F.col("embedding"), lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", u.alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


_LEX = f"SELECT qid, id, rank FROM ({top_sql('bm', 30)})"


@query(f"""
WITH {BM25}, lx AS ({_LEX}),
dn AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id),
dx AS ({top_sql('dn', 30)}), e AS (SELECT qid, id, rank, 0 AS p FROM lx UNION ALL SELECT qid, id, rank, 1 FROM dx WHERE qid IN (SELECT qid FROM lx)),
f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(p * 1000 + rank) AS first, max(CASE WHEN p = 0 THEN rank END) AS bm25_rank, max(CASE WHEN p = 1 THEN rank END) AS dense_rank FROM e GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM f)
SELECT t.qid, t.id, CAST(t.rank AS BIGINT) AS rank, t.score, bm25_rank, dense_rank, round(dn.score, 6) AS dense_sim, t.qid % {EVERY} = 0 AS dense_available FROM t LEFT JOIN dn ON dn.qid = t.qid AND dn.id = t.id WHERE t.rank <= 5""")
def hybrid_degraded(spark, d):
    """Hybrid search where only every hundredth question has a vector: the others are lexical, and
    each hit's similarity is filled in where there is one."""
    words = lexical(spark, d, 30)
    near = dense_list(spark, d, 30).join(words.select("qid").distinct(), "qid", "left_semi")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    rows = retrieval.with_similarity(retrieval.fuse([("bm25", words), ("dense", near)]), asked, v)
    return rows.select("qid", "id", F.col("rank").cast("long").alias("rank"), "score", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("dense_rank").cast("long").alias("dense_rank"), "dense_sim", "dense_available")


#: Words of a window in the baseline mode, and windows of a block of its index (a document has about ten).
WINDOW, WINDOW_BLOCK = 40, 8192


@query(f"""
WITH {BM25}, wd AS (SELECT doc_id AS id, {words_sql()} AS w FROM documents),
{bm25_sql(f"SELECT id, w[k * {WINDOW} + 1 : k * {WINDOW} + {WINDOW}] AS words FROM (SELECT id, w, unnest(range(0, (len(w) + {WINDOW - 1}) // {WINDOW})) AS k FROM wd)", "w")},
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM bmw), u AS (SELECT qid, id, min(place) AS place FROM r WHERE place <= 9 GROUP BY 1, 2)
SELECT qid, id, 'structured' AS mode, rank FROM ({top_sql('bm', 3)})
UNION ALL SELECT qid, id, 'baseline', CAST(rank AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM u) WHERE rank <= 3""")
def search_mode(spark, d):
    """One search over the units that a mode names: whole documents, or windows of them that are found as one."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / WINDOW)))
    windows = lambda: texts(spark, d).where(F.size("words") > 0).select("id", "words", at.alias("k")).select("id", F.array_join(F.slice("words", (F.col("k") * WINDOW + 1).cast("int"), F.lit(WINDOW)), " ").alias("key"))
    units = {"structured": index(spark, d), "baseline": retrieval.standing(spark, f"windows of {d}", windows, WINDOW_BLOCK)}
    rows = [retrieval.search(units, mode, question_terms(spark, d), 3, windows={"baseline": 3}) for mode in units]
    return rows[0].unionByName(rows[1]).select("qid", "id", "mode", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH q AS (SELECT item_id AS qid, {words_sql()} AS w FROM benchmark ), qt AS (SELECT DISTINCT qid, substr(term, 1, CASE WHEN length(term) > 5 THEN length(term) - 1 ELSE length(term) END) AS qterm FROM (SELECT qid, unnest(w) AS term FROM q) WHERE length(term) >= 2),
dw AS (SELECT item_id AS id, {words_sql()} AS words FROM benchmark), st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM dw), dt AS (SELECT id, unnest(words) AS term FROM dw),
tm AS (SELECT DISTINCT qid, qterm, term FROM qt JOIN (SELECT DISTINCT term FROM dt) ON CASE WHEN length(qterm) >= 4 THEN starts_with(term, qterm) ELSE term = qterm END),
tf AS (SELECT qid, qterm, id, count(*) AS tf FROM tm JOIN dt USING (term) GROUP BY 1, 2, 3), df AS (SELECT qid, qterm, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT tf.qid, tf.id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))), 6) AS score FROM tf JOIN df ON df.qid = tf.qid AND df.qterm = tf.qterm JOIN dw ON dw.id = tf.id, st GROUP BY 1, 2)
SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5""")
def bm25_prefix(spark, d):
    """BM25 in which terms of four letters or more match whatever they begin; a term's matches add up."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.words(N.latin_key(F.col("text"))).alias("words"))
    cut = F.when(F.length("t") > 5, F.substring("t", F.lit(1), F.length("t") - 1)).otherwise(F.col("t"))
    q = b.select(F.col("id").alias("qid"), F.explode("words").alias("t")).where(F.length("t") >= 2).select("qid", cut.alias("qterm")).distinct()
    rows = retrieval.ranked(retrieval.bm25(b, q, prefix=True), 5)
    return rows.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))
