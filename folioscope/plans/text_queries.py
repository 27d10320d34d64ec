"""Queries on keys, tokens, known passages and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import chunking, spans, structure
from folioscope.sources.io import table

from .key_queries import MARKED_SQL, marked
from .registry import GRAMS, key_sql, registry, words_sql
from .retrieval_queries import BM25, lexical, top_sql

QUERIES, ORACLES, query = registry()


def streams(spark, d):
    """Word arrays of passages and texts."""
    key = N.latin_key(F.col("text"))
    texts = spans.word_stream(table(spark, d, "documents").select("doc_id", key.alias("key")), "doc_id", "key")
    passages = spans.word_stream(table(spark, d, "benchmark").select("item_id", key.alias("key")), "item_id", "key")
    return passages, texts


@query(f"SELECT doc_id, {key_sql()} AS key, length({key_sql()}) AS key_chars FROM documents")
def norm_keys(spark, d):
    key = N.latin_key(F.col("text"))
    return table(spark, d, "documents").select("doc_id", key.alias("key")).withColumn("key_chars", F.length("key").cast("long"))


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([(\[{«])\s+', '\1', 'g'), '\s+([)\]}».:,])', '\1', 'g'), '\s+(\([0-9]{1,3}\))', '\1', 'g')"""


@query(f"SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY {_CANON} HAVING count(*) > 1")
def canon_groups(spark, d):
    docs = table(spark, d, "documents").withColumn("canon", F.sha2(N.canon(F.col("text"), stable=True), 256))
    return docs.groupBy("canon").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").select("first_doc", "n")


PREFIXES = ("and", "the", "in", "of", "th")


@query(f"""
WITH w AS (SELECT item_id, unnest({words_sql()}) AS word FROM benchmark), v AS (
  SELECT item_id, word AS term FROM w WHERE length(word) >= 2
  {"".join(f"UNION ALL SELECT item_id, substr(word, {len(p) + 1}) FROM w WHERE length(word) >= 2 AND starts_with(word, '{p}') AND length(word) - {len(p)} >= 3 " for p in PREFIXES)})
SELECT DISTINCT item_id, term FROM v""")
def term_variants(spark, d):
    terms = T.query_terms(N.latin_key(F.col("text")), PREFIXES)
    return table(spark, d, "benchmark").select("item_id", F.explode(terms).alias("term"))


@query(rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all({MARKED_SQL}, '(\(\s*[0-9]{{1,2}}\s*\))', 1)) AS raw FROM documents)
SELECT doc_id, raw, CASE WHEN ltrim(regexp_extract(raw, '[0-9]+'), '0') = '' THEN '0' ELSE ltrim(regexp_extract(raw, '[0-9]+'), '0') END AS marker, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def marker_extract(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.markers(marked(F.col("text")))).alias("raw"))
    # A marker is told by its print, so it is made for each group, not for each place.
    return rows.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).select("doc_id", "raw", N.normalize_marker(F.col("raw")).alias("marker"), "n")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, len(parts) AS n_sentences, list_max(list_transform(parts, lambda x: length(x))) AS longest FROM s""")
def sentences(spark, d):
    parts = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.array_max(F.transform(parts, lambda s: F.length(s))).cast("long").alias("longest"))


@query(r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) <= 12 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:12], ' ') || ' …' END AS excerpt FROM w""")
def excerpt(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.excerpt(F.col("text"), 12).alias("excerpt"))


@query(f"""
WITH w AS (SELECT unnest(list_distinct({words_sql()})) AS word FROM documents), n AS (SELECT count(*) AS total FROM documents)
SELECT word, count(*) AS df, round(ln(max(total) / count(*)::DOUBLE), 6) AS idf FROM w, n GROUP BY word""")
def idf(spark, d):
    return spans.idf(streams(spark, d)[1])


@query(f"WITH {GRAMS} SELECT passage_id, text_id, start, votes FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY votes DESC, text_id, start) AS rank FROM votes) WHERE rank <= 20")
def trigram_votes(spark, d):
    rows = spans.best_starts(spans.votes(*streams(spark, d)))
    return rows.select("passage_id", "text_id", F.col("start").cast("long"), "votes")


@query(f"""
WITH {GRAMS}, hit AS (SELECT DISTINCT id, pos FROM t3 SEMI JOIN p3 USING (gram)),
i AS (SELECT id, pos, CASE WHEN pos - coalesce(lag(pos) OVER w, -10) > 3 THEN 1 ELSE 0 END AS fresh FROM hit WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, pos, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS island FROM i)
SELECT id AS text_id, min(pos) AS first, max(pos) + 2 AS last, max(pos) + 3 - min(pos) AS n_words FROM r GROUP BY id, island HAVING max(pos) + 3 - min(pos) >= 6""")
def known_passage_runs(spark, d):
    passages, texts = streams(spark, d)
    return spans.runs(texts, passages).select("text_id", *[F.col(c).cast("long") for c in ("first", "last", "n_words")])


def _windows_sql(slack: int) -> str:
    """Windows of the rows of ``starts`` at lengths within ``slack`` of the passage's, and their similarity."""
    return f"""
win AS (
  SELECT b.passage_id, b.text_id, b.start, b.votes, array_to_string(p.words, ' ') AS passage,
         array_to_string(t.words[greatest(b.start, 0) + 1 : greatest(b.start, 0) + greatest(n + least(b.start, 0), 1)], ' ') AS win
  FROM starts b JOIN pw p ON p.id = b.passage_id JOIN tw t ON t.id = b.text_id, unnest(range(greatest(len(p.words) - {slack}, 1), len(p.words) + {slack} + 1)) AS l(n)
), sim AS (SELECT passage_id, text_id, start, votes, round(CASE WHEN greatest(length(passage), length(win)) = 0 THEN 1.0 ELSE 1 - levenshtein(passage, win) / greatest(length(passage), length(win))::DOUBLE END, 6) AS similarity FROM win)"""


@query(f"""
WITH {GRAMS}, starts AS (SELECT * FROM votes), {_windows_sql(2)},
best AS (SELECT passage_id, text_id, start, max(similarity) AS similarity FROM sim GROUP BY 1, 2, 3)
SELECT passage_id, text_id, start, similarity, CASE WHEN similarity = 1 THEN 'exact' WHEN similarity >= 0.85 THEN 'minor_variant' ELSE 'mismatch' END AS status
FROM best WHERE similarity >= 0.6""")
def passage_verify(spark, d):
    """Every voted start of every text, at the best of the lengths within two words of the passage's."""
    passages, texts = streams(spark, d)
    rows = spans.windows(spans.votes(passages, texts), passages, texts, slack=2)
    rows = rows.groupBy("passage_id", "text_id", "start").agg(F.max("similarity").alias("similarity"))
    return rows.where("similarity >= 0.6").select("passage_id", "text_id", F.col("start").cast("long"), "similarity", spans.classify(F.col("similarity")).alias("status"))


@query(f"""
WITH {GRAMS}, starts AS (SELECT passage_id, text_id, start + d AS start, max(CASE WHEN d = 0 THEN votes ELSE 0 END) AS votes FROM votes, (VALUES (-1), (0), (1)) o(d) GROUP BY 1, 2, 3), {_windows_sql(1)},
texts AS (SELECT passage_id, text_id, start, votes, similarity, row_number() OVER (PARTITION BY passage_id, text_id ORDER BY similarity DESC, votes DESC, start) AS i FROM sim),
placed AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY similarity DESC, votes DESC, text_id, start) AS place FROM texts WHERE i = 1)
SELECT passage_id, CAST(place AS BIGINT) AS place, text_id, start, similarity FROM placed WHERE place <= 3""")
def span_candidates(spark, d):
    """Each passage's three best texts, by their best window: all voted starts and those next to
    them, at the lengths within one word of the passage's, are compared before any is left out."""
    from pyspark.sql import Window

    passages, texts = streams(spark, d)
    starts = spans.votes(passages, texts).withColumn("start", F.explode(F.array(*[F.struct((F.col("start") + k).alias("start"), (F.col("votes") if k == 0 else F.lit(0).cast("long")).alias("votes")) for k in (-1, 0, 1)])))
    starts = starts.select("passage_id", "text_id", "start.*").groupBy("passage_id", "text_id", "start").agg(F.max("votes").alias("votes"))
    rows = spans.windows(starts, passages, texts, slack=1)
    best = F.max(F.struct("similarity", "votes", (-F.col("start")).alias("first"))).alias("b")
    rows = rows.groupBy("passage_id", "text_id").agg(best).select("passage_id", "text_id", "b.similarity", "b.votes", (-F.col("b.first")).alias("start"))
    w = Window.partitionBy("passage_id").orderBy(F.desc("similarity"), F.desc("votes"), "text_id", "start")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("passage_id", "place", "text_id", F.col("start").cast("long"), "similarity")


@query(f"""
WITH {GRAMS}, pairs AS (SELECT DISTINCT passage_id, text_id FROM votes WHERE votes >= 4),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM tw) GROUP BY word),
n AS (SELECT count(*) AS total FROM tw),
w AS (SELECT pw.id AS passage_id, u.word, coalesce(round(ln(total / df::DOUBLE), 6), 8.0) AS idf FROM pw, unnest(pw.words) AS u(word), n LEFT JOIN df ON df.word = u.word)
SELECT p.passage_id, p.text_id, round(CASE WHEN sum(idf) > 0 THEN sum(CASE WHEN list_contains(t.words, w.word) THEN idf ELSE 0 END) / sum(idf) ELSE 1.0 END, 4) AS overlap
FROM pairs p JOIN w ON w.passage_id = p.passage_id JOIN tw t ON t.id = p.text_id GROUP BY 1, 2""")
def weighted_overlap(spark, d):
    passages, texts = streams(spark, d)
    pairs = spans.votes(passages, texts).where("votes >= 4")
    return spans.weighted_overlap(pairs, passages, texts, spans.idf(texts))


@query(f"""
WITH w AS (SELECT doc_id AS id, source AS scope, {words_sql()} AS words FROM documents),
g AS (SELECT id, scope, unnest(range(0, greatest(len(words) - 11, 0))) AS pos, words FROM w),
s AS (SELECT id, scope, array_to_string(words[pos + 1 : pos + 12], ' ') AS gram FROM g),
o AS (SELECT scope, gram, min(id) AS owner FROM s GROUP BY 1, 2 HAVING min(id) < max(id))
SELECT s.scope, s.id, min(o.owner) AS owner FROM s JOIN o USING (scope, gram) WHERE o.owner < s.id GROUP BY 1, 2""")
def dup_shingles(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", T.words(N.latin_key(F.col("text"))).alias("words"))
    return structure.repeated_shingles(texts, "source")


@query(f"""
WITH {GRAMS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY votes DESC, text_id, start) AS rank FROM votes) WHERE rank = 1),
seg AS (SELECT item_id, unnest(list_filter(string_split(text, '.'), lambda s: length({key_sql('s')}) >= 8)) AS s FROM benchmark),
hit AS (SELECT seg.item_id, coalesce(contains(' ' || array_to_string(t.words, ' ') || ' ', ' ' || {key_sql('seg.s')} || ' '), false) AS found
        FROM seg LEFT JOIN best b ON b.passage_id = seg.item_id LEFT JOIN tw t ON t.id = b.text_id)
SELECT item_id, count(*) AS n_segments, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM hit GROUP BY 1""")
def coverage(spark, d):
    passages, texts = streams(spark, d)
    best = spans.best_starts(spans.votes(passages, texts), 1).select(F.col("passage_id").alias("item_id"), F.col("text_id").alias("id")).join(texts, "id")
    segs = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\.")).alias("s")).withColumn("key", N.latin_key(F.col("s"))).where(F.length("key") >= 8)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    found = F.coalesce(F.contains(pad(F.array_join("words", " ")), pad(F.col("key"))), F.lit(False))
    return structure.coverage(segs.join(best, "item_id", "left"), found, ["item_id"])


@query("""
WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS fresh FROM conversations),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, CAST(island AS BIGINT) AS run, min(role) AS role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM i GROUP BY 1, 2""")
def ordered_runs(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    fresh = F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True))
    rows = structure.islands(rows.withColumn("_new", fresh), ["conv_id"], "turn", F.col("_new"))
    return rows.groupBy("conv_id", F.col("island").alias("run")).agg(F.min("role").alias("role"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))


_ANCHORS = "SELECT l_orderkey AS page, l_linenumber AS ord, CAST(l_partkey % 5 AS VARCHAR) AS marker FROM lineitem"
_NOTES = "SELECT l_orderkey AS page, l_linenumber AS ord, CAST(l_suppkey % 5 AS VARCHAR) AS marker FROM lineitem"


@query(f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY page, marker ORDER BY ord) AS k FROM ({_ANCHORS})),
n AS (SELECT *, row_number() OVER (PARTITION BY page, marker ORDER BY ord) AS k FROM ({_NOTES})),
e AS (SELECT a.page, a.ord AS anchor_ord, n.ord AS note_ord FROM a JOIN n USING (page, marker) WHERE a.k = 1 AND n.k = 1),
la AS (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = a.page AND e.anchor_ord = a.ord)),
ln AS (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = n.page AND e.note_ord = n.ord))
SELECT page, anchor_ord, note_ord, 1.0::DOUBLE AS confidence, 'exact' AS method FROM e
UNION ALL SELECT la.page, la.ord, ln.ord, 0.6::DOUBLE, 'ordinal' FROM la JOIN ln USING (page, i)""")
def ordinal_link(spark, d):
    lines = table(spark, d, "lineitem")
    rows = lambda c: lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), (F.col(c) % 5).cast("string").alias("marker"))
    return structure.link_notes(rows("l_partkey"), rows("l_suppkey"))


@query("""
SELECT conv_id, turn, CASE WHEN lag(role) OVER w = 'user' AND role = 'assistant' AND regexp_matches(rtrim(lag(text) OVER w), '[.]$') THEN lag(turn) OVER w END AS attached_to
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def colon_attach(spark, d):
    """The colon rule, with the full stop in the colon's place, as no turn ends in a colon."""
    rows = table(spark, d, "conversations").withColumn("t", F.regexp_replace(F.rtrim("text"), r"\.$", ":"))
    rows = rows.withColumn("is_user", F.col("role") == "user")
    out = structure.attach_after_colon(rows, "conv_id", "turn", "t", F.col("is_user"), F.col("role") == "assistant")
    return out.select("conv_id", "turn", "attached_to")


@query("""
WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sec FROM conversations),
u AS (SELECT *, CASE WHEN role = 'system' THEN 0 ELSE sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, sec ORDER BY turn) END AS n FROM s),
k AS (SELECT *, CASE WHEN n > 0 THEN sec * 100000 + n END AS key FROM u)
SELECT conv_id, unit, min(turn) AS first, max(turn) AS last, count(*) AS n FROM
  (SELECT *, CASE WHEN key IS NOT NULL THEN dense_rank() OVER (PARTITION BY conv_id ORDER BY key NULLS LAST) END AS unit FROM k) WHERE unit IS NOT NULL GROUP BY 1, 2""")
def turn_units(spark, d):
    rows = chunking.group_units(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "system")
    return rows.where("unit is not null").groupBy("conv_id", F.col("unit").cast("long").alias("unit")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"))


@query(r"""
WITH c AS (SELECT source, string_agg(replace(text, chr(10), ' ') || ' ', '' ORDER BY doc_id) AS t FROM documents GROUP BY source),
k AS (SELECT source, t, unnest(generate_series(0, CAST(floor((length(t) - 1) / 450) AS BIGINT))) AS chunk FROM c)
SELECT source, chunk, length(substr(t, chunk * 450 + 1, 500)) AS n_chars, md5(substr(t, chunk * 450 + 1, 500)) AS digest FROM k""")
def fixed_chunks(spark, d):
    rows = chunking.fixed_chunks(table(spark, d, "documents"), "source", "doc_id", "text")
    return rows.select(F.col("by").alias("source"), "chunk", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""
WITH {BM25}, u AS (SELECT doc_id AS id, source AS grp, lang AS kind, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents),
h AS ({top_sql('bm', 2)}),
o AS (SELECT * FROM (VALUES (0, -1), (1, 1), (2, -2), (3, 2)) t(i, d)),
n AS (SELECT h.qid, v.id, min(h.rank * 10 + o.i) AS k FROM h JOIN u ON u.id = h.id, o JOIN u v ON v.grp = u.grp AND v.kind = u.kind AND v.pos = u.pos + o.d
      WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.qid = h.qid AND x.id = v.id) GROUP BY 1, 2)
SELECT qid, id, CAST(place AS BIGINT) AS place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS place FROM n) WHERE place <= 3""")
def neighbours(spark, d):
    """Neighbours of the first two hits of every question of ``bm25_topk``."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    units = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.col("lang").alias("kind"), F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).alias("pos"))
    hits = lexical(spark, d, 2).select("qid", "id", "rank")
    return chunking.neighbours(hits, units).withColumn("place", F.col("place").cast("long"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title,
       len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""")
def html_extract(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    title = N.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), count("<p>").alias("n_paragraphs"), count("<a href=").alias("n_links"))
