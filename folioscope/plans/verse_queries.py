"""Queries on a numbered reference: the passages are its lines, ten a book; turns of conversations and documents quote it."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import gates, reference, spans, verses
from folioscope.sources.io import table

from .registry import registry, words_sql

QUERIES, ORACLES, query = registry()


def lines(spark, d):
    rows = table(spark, d, "benchmark").select((F.col("item_id") / 10).cast("int").alias("book"), (F.col("item_id") % 10).cast("int").alias("no"), T.words(N.latin_key(F.col("text"))).alias("words"))
    return rows.where(F.size("words") >= 2)


def quotes(spark, d):
    """Each passage's words from the fourth on, up to twelve; every third with a word changed, every fourth with one left out."""
    w = T.words(N.latin_key(F.col("text")))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.slice(w, 4, 12).alias("w")).where(F.size("w") >= 8)
    changed = F.concat(F.slice("w", 1, 4), F.array(F.lit("zzz")), F.slice("w", 6, F.size("w")))
    fewer = F.concat(F.slice("w", 1, 5), F.slice("w", 7, F.size("w")))
    return rows.select("qid", F.when(F.col("qid") % 3 == 1, changed).when(F.col("qid") % 4 == 2, fewer).otherwise(F.col("w")).alias("words"))


_REF = f"""
ln AS (SELECT CAST(floor(item_id / 10) AS INTEGER) AS book, CAST(item_id % 10 AS INTEGER) AS no, {words_sql()} AS words FROM benchmark),
rf AS (SELECT book, no, i, words[i + 1] AS word FROM (SELECT book, no, words, unnest(range(0, len(words))) AS i FROM ln WHERE len(words) >= 2)),
st AS (SELECT row_number() OVER (ORDER BY book, no, i) - 1 AS pos, word, book, no FROM rf),
sg AS (SELECT *, lead(word, 1) OVER (ORDER BY pos) AS w1, lead(word, 2) OVER (ORDER BY pos) AS w2 FROM st),
qw AS (SELECT qid, CASE WHEN qid % 3 = 1 THEN list_concat(list_concat(w[1:4], ['zzz']), w[6:len(w)]) WHEN qid % 4 = 2 THEN list_concat(w[1:5], w[7:len(w)]) ELSE w END AS words FROM (SELECT item_id AS qid, {words_sql()}[4:15] AS w FROM benchmark) WHERE len(w) >= 8),
qg AS (SELECT qid, i, words[i + 1] AS word, words[i + 2] AS w1, words[i + 3] AS w2 FROM (SELECT qid, words, unnest(range(0, len(words) - 2)) AS i FROM qw)),
vt AS (SELECT qid, pos - i AS start, count(*) AS votes, min(i) AS first FROM qg JOIN sg USING (word, w1, w2) GROUP BY 1, 2),
fb AS (SELECT qid, pos AS start, 1 AS votes, 0 AS first FROM qw JOIN sg ON sg.word = words[1] AND sg.w1 = words[2] WHERE qid NOT IN (SELECT qid FROM vt)),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, first, start) AS rank FROM (SELECT * FROM vt UNION ALL SELECT * FROM fb)),
top AS (SELECT qid, start, votes, rank FROM sr WHERE rank <= 20)"""


@query(f"WITH {_REF} SELECT CAST(pos AS BIGINT) AS pos, word, w1, w2, book, no FROM sg")
def reference_words(spark, d):
    """The reference's words in one stream; trigrams run on over the borders of lines and books."""
    return verses.reference_stream(lines(spark, d)).select(F.col("pos").cast("long").alias("pos"), "word", "w1", "w2", "book", "no")


@query(f"WITH {_REF} SELECT qid, CAST(start AS BIGINT) AS start, CAST(votes AS BIGINT) AS votes, CAST(rank AS BIGINT) AS rank FROM top")
def quote_starts(spark, d):
    """Up to twenty voted starts of each quotation."""
    rows = verses.candidate_starts(quotes(spark, d), verses.reference_stream(lines(spark, d)))
    return rows.select("qid", *[F.col(c).cast("long").alias(c) for c in ("start", "votes", "rank")])


_SIM = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END"
_WINDOW = f"""
all_words AS (SELECT list(word ORDER BY pos) AS ws, count(*) AS n FROM st),
wn AS (SELECT qid, rank, l AS len, greatest(start, 0) AS f, least(start + l, n) AS t, array_to_string(words, ' ') AS a, array_to_string(ws[greatest(start, 0) + 1 : least(start + l, n)], ' ') AS b
  FROM top JOIN qw USING (qid), all_words, unnest(range(greatest(len(words) - 2, 1), len(words) + 3)) AS u(l) WHERE least(start + l, n) > greatest(start, 0)),
ws AS (SELECT *, {_SIM} AS sim FROM wn),
bw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rank, len) AS k FROM ws) WHERE k = 1)"""


@query(f"WITH {_REF}, {_WINDOW} SELECT qid, CAST(f AS BIGINT) AS first, CAST(t AS BIGINT) AS last, b AS window_text, round(sim, 6) AS similarity FROM bw")
def quote_windows(spark, d):
    """Each quotation's most similar window, at lengths within two words of its own."""
    q, ref = quotes(spark, d), verses.reference_stream(lines(spark, d))
    rows = verses.best_windows(verses.cut_windows(verses.candidate_starts(q, ref), q, ref))
    return rows.select("qid", F.col("from").cast("long").alias("first"), F.col("to").cast("long").alias("last"), F.array_join("window", " ").alias("window_text"), F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH {_REF}, {_WINDOW}, x AS (SELECT bw.*, words FROM bw JOIN qw USING (qid)),
p AS (SELECT qid, f + i AS f, f + i + len(words) AS t FROM x, unnest(range(0, 5)) AS u(i) WHERE array_to_string(string_split(b, ' ')[i + 1 : i + len(words)], ' ') = a)
SELECT p.qid, s.book, s.no AS first, CASE WHEN s.book = e.book THEN e.no ELSE s.no END AS last, 1.0::DOUBLE AS similarity, 'exact' AS status, CAST(0 AS BIGINT) AS n_ops FROM p JOIN st s ON s.pos = p.f JOIN st e ON e.pos = p.t - 1""")
def exact_quotes(spark, d):
    """Quotations that the reference holds word for word (the whole check, without the inexact ones)."""
    rows = verses.verify(quotes(spark, d), verses.reference_stream(lines(spark, d))).where("status = 'exact'")
    return rows.select("qid", "book", "first", "last", F.round("similarity", 6).alias("similarity"), "status", F.size("ops").cast("long").alias("n_ops"))


@query()
def verified_quotes(spark, d):
    """The whole check of each quotation, with its differences; every line is its own other spelling."""
    rows = verses.verify(quotes(spark, d), verses.reference_stream(lines(spark, d)), lines(spark, d))
    return rows.select("qid", "book", "first", "last", "similarity", "status", F.size("ops").alias("n_ops"))


@query()
def unmarked_quotes(spark, d):
    """Quotations in documents that nothing marks."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), T.words(N.latin_key(F.col("text"))).alias("words"))
    return verses.find_unmarked(texts, verses.reference_stream(lines(spark, d)))


@query(f"""
WITH {_REF}, v AS (SELECT DISTINCT word FROM rf)
SELECT word, CASE WHEN starts_with(word, 't') AND length(word) > 3 THEN substr(word, 2) ELSE 't' || word END AS variant FROM v""")
def word_forms(spark, d):
    """Each word with its other form, t standing in for the conjunction."""
    words = lines(spark, d).select(F.explode("words").alias("word")).distinct()
    return words.select("word", verses.word_variants(F.col("word"), "t")[1].alias("variant"))


@query(f"""
WITH {_REF}, {_WINDOW}, df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT book, no, word FROM rf) GROUP BY 1), nl AS (SELECT count(*) AS n FROM ln WHERE len(words) >= 2),
e AS (SELECT qid, b, unnest(string_split(a, ' ')) AS word FROM bw),
i AS (SELECT e.qid, coalesce(round(ln(nl.n / df.df::DOUBLE), 6), 8.0::DOUBLE) AS idf, list_contains(string_split(b, ' '), e.word) OR list_contains(string_split(b, ' '), 't' || e.word) OR list_contains(list_transform(list_filter(string_split(b, ' '), lambda w: starts_with(w, 't')), lambda w: substr(w, 2)), e.word) AS got FROM e CROSS JOIN nl LEFT JOIN df USING (word))
SELECT qid, round(CASE WHEN sum(idf) > 0 THEN sum(CASE WHEN got THEN idf ELSE 0 END) / sum(idf) ELSE 1.0 END, 6) AS overlap FROM i GROUP BY 1""")
def quote_overlap(spark, d):
    """How much of a quotation's weight its best window has."""
    q, ref = quotes(spark, d), verses.reference_stream(lines(spark, d))
    best = verses.best_windows(verses.cut_windows(verses.candidate_starts(q, ref), q, ref)).withColumn("key", F.col("qid"))
    weights = spans.idf(lines(spark, d))
    return verses.overlap(best, weights, joiner="t").select("qid", F.round("overlap", 6).alias("overlap"))


@query()
def quote_candidates(spark, d):
    """Up to three lines that each quotation may be."""
    q, ref = quotes(spark, d), verses.reference_stream(lines(spark, d))
    rows = verses.candidates(q, ref, spans.idf(lines(spark, d)))
    return rows.select("qid", "place", "book", "first", "last", "similarity", "overlap")


@query()
def quoted_check(spark, d):
    """What a reader is told about each quotation."""
    q, ref = quotes(spark, d), verses.reference_stream(lines(spark, d))
    found = verses.verify(q, ref)
    ranked = verses.candidates(q, ref, spans.idf(lines(spark, d)), top=6).withColumn("ops", F.col("place") * 0)
    ranked = ranked.withColumn("t", verses.trimmed(F.col("printed"), F.col("window")))
    return verses.check_quoted(found, ranked, gates.function_words_only(F.col("t.ops")))


@query(f"""
WITH ln AS (SELECT CAST(floor(item_id / 10) AS INTEGER) AS book, CAST(item_id % 10 AS INTEGER) AS no, text FROM benchmark),
r AS (SELECT DISTINCT doc_id AS id, CAST(doc_id % 25 AS INTEGER) AS book, CAST(doc_id % 4 AS INTEGER) AS first, CAST(doc_id % 4 + doc_id % 3 AS INTEGER) AS last FROM documents)
SELECT r.id, string_agg(text, ' ' ORDER BY no) AS text FROM r LEFT JOIN ln ON ln.book = r.book AND no BETWEEN first AND last GROUP BY 1""")
def range_texts(spark, d):
    """The lines of a range as one text; null where the book has none."""
    rows = table(spark, d, "benchmark").select((F.col("item_id") / 10).cast("int").alias("book"), (F.col("item_id") % 10).cast("int").alias("no"), "text")
    i = F.col("doc_id")
    ranges = table(spark, d, "documents").select(i.alias("id"), (i % 25).cast("int").alias("book"), (i % 4).cast("int").alias("first"), (i % 4 + i % 3).cast("int").alias("last"))
    return reference.range_text(ranges, rows)


@query("""
WITH refs AS (SELECT o_orderkey AS block, CAST(o_custkey % 7 AS INTEGER) AS book, CAST(o_orderkey % 10 AS INTEGER) AS first, CAST(o_orderkey % 10 + o_custkey % 3 AS INTEGER) AS last FROM orders),
blocks AS (SELECT DISTINCT l_orderkey AS block, CAST(l_partkey % 50 AS VARCHAR) AS page FROM lineitem)
SELECT DISTINCT page AS page_id FROM refs JOIN blocks USING (block) WHERE book = 3 AND 5 BETWEEN first AND last""")
def pages_of_line(spark, d):
    """Pages of blocks that quote the fifth line of the third book."""
    o = table(spark, d, "orders")
    refs = o.select(F.col("o_orderkey").alias("block_id"), (F.col("o_custkey") % 7).cast("int").alias("book"), (F.col("o_orderkey") % 10).cast("int").alias("first"), (F.col("o_orderkey") % 10 + F.col("o_custkey") % 3).cast("int").alias("last"))
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), (F.col("l_partkey") % 50).cast("string").alias("page_id")).distinct()
    return reference.pages_with(refs, blocks, 3, F.lit(5))


@query(f"""
WITH {_REF}, df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT book, no, word FROM rf) GROUP BY 1), nl AS (SELECT count(*) AS n FROM ln WHERE len(words) >= 2),
lw AS (SELECT DISTINCT book * 10 + no AS id, word FROM rf), qd AS (SELECT DISTINCT qid, unnest(words) AS word FROM qw),
h AS (SELECT qid, id, round(sum(round(ln(nl.n / df.df::DOUBLE), 6)), 6) AS score FROM qd JOIN lw USING (word) JOIN df USING (word), nl GROUP BY 1, 2 HAVING sum(round(ln(nl.n / df.df::DOUBLE), 6)) > 0),
lx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS rank FROM h),
dn AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN qw ON qw.qid = q.vec_id, embeddings v WHERE v.vec_id < (SELECT count(*) FROM benchmark) AND v.vec_id <> q.vec_id),
dx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dn),
ev AS (SELECT qid, id, rank, 0 AS p FROM lx WHERE rank <= 30 UNION ALL SELECT qid, id, rank, 1 FROM dx WHERE rank <= 30),
fu AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(p * 1000 + rank) AS first FROM ev GROUP BY 1, 2)
SELECT qid, id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM fu) WHERE rank <= 5""")
def verse_search(spark, d):
    """Lines by the weights of a quotation's words (ties to the later line), fused with the nearest vectors."""
    own = lines(spark, d).select((F.col("book") * 10 + F.col("no")).cast("long").alias("id"), F.explode("words").alias("word"))
    q = quotes(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = table(spark, d, "benchmark").count()
    from folioscope.operators import retrieval

    dense = retrieval.dense_top(v.withColumnRenamed("id", "qid").withColumnRenamed("vec", "qvec").join(q.select("qid"), "qid", "left_semi"), v.where(F.col("id") < n), 30).select("qid", "id", "score")
    rows = reference.verse_search(q.select("qid", F.explode("words").alias("word")), own, spans.idf(lines(spark, d)), dense)
    return rows.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(r"""
WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'page_header' WHEN turn % 5 = 0 THEN 'quran' ELSE 'body' END AS type, text,
  list_transform(regexp_extract_all(text || ' {' || left(text, 12) || '}', '[﴿{]([^﴿﴾{}]+)[﴾}]', 1), lambda x: trim(x)) AS br, [left(text, 6), right(text, 9)] AS un FROM conversations WHERE text IS NOT NULL),
s AS (
  SELECT conv_id, turn, 'block' AS kind, text AS span FROM b WHERE type = 'quran'
  UNION ALL SELECT conv_id, turn, 'bracketed', unnest(br) FROM b WHERE type = 'body'
  UNION ALL SELECT conv_id, turn, 'unmarked', unnest(list_filter(un, lambda x: NOT contains(array_to_string(br, ' '), x))) FROM b WHERE type = 'body')
SELECT conv_id, turn, kind, span FROM s""")
def compared_spans(spark, d):
    """What of a block is compared with the reference: all of it, its bracketed spans, or unmarked ones outside them."""
    rows = table(spark, d, "conversations").where("text is not null")
    kind = F.when(F.col("role") == "system", "page_header").when(F.col("turn") % 5 == 0, "quran").otherwise("body")
    blocks = rows.select(F.struct("conv_id", "turn").alias("block_id"), kind.alias("type"), "text")
    spans_ = T.bracketed(F.concat("text", F.lit(" {"), F.left("text", F.lit(12)), F.lit("}")))
    out = reference.span_sources(blocks, spans_, F.array(F.left("text", F.lit(6)), F.right("text", F.lit(9))))
    return out.select("block_id.conv_id", "block_id.turn", "kind", "span")
