"""Whole views: pages, books, contexts, states of answers, reports, keys of compatibility forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.constants import LONG_MARKER
from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import gates, metrics, reference, retrieval
from folioscope.sources.io import table
from folioscope.sources.store import scratch_path

from .key_queries import LATIN, scribe, scribe_sql, search_sql
from .registry import key_sql, registry, words_sql
from .unit_queries import _BLOCKS, blocks

QUERIES, ORACLES, query = registry()

_PAGES = f"{_BLOCKS}, p AS (SELECT DISTINCT book, pos // 4 AS no, page_id FROM bk)"


@query(f"""
WITH {_PAGES}, n AS (SELECT *, lag(page_id) OVER w AS b, lag(no) OVER w AS bn, lead(page_id) OVER w AS a, lead(no) OVER w AS an FROM p WINDOW w AS (PARTITION BY book ORDER BY no)),
l AS (SELECT page_id, string_agg(book || '-' || (pos - 2) || '>' || block_id || '@' || CASE WHEN pos % 2 = 0 THEN '1.0' ELSE '0.6' END, ',' ORDER BY book || '-' || (pos - 2), block_id) AS links FROM bk WHERE type = 'footnote' GROUP BY 1),
r AS (SELECT page_id, string_agg(block_id || ':' || pos % 7 || ':' || length(text) % 9, ',' ORDER BY block_id, pos % 7, length(text) % 9) AS refs FROM bk WHERE pos % 5 = 2 GROUP BY 1),
h AS (SELECT page_id, string_agg(DISTINCT book || '.' || pos // 3, ',' ORDER BY book || '.' || pos // 3) AS reports FROM bk WHERE type = 'hadith' GROUP BY 1)
SELECT n.book, n.page_id, CASE WHEN bn = no - 1 THEN b END AS before, CASE WHEN an = no + 1 THEN a END AS after, (SELECT count(*) FROM bk WHERE bk.page_id = n.page_id) AS n_blocks, coalesce(links, '') AS links, coalesce(refs, '') AS refs, coalesce(reports, '') AS reports
FROM n LEFT JOIN l USING (page_id) LEFT JOIN r USING (page_id) LEFT JOIN h USING (page_id)""")
def full_pages(spark, d):
    """Pages with blocks, neighbours, links of notes, references and reports that touch them."""
    b = blocks(spark, d)
    s = lambda c: c.cast("string")
    pages = b.select("book", F.floor(F.col("pos") / 4).alias("no"), "page_id").distinct()
    links = b.where("type = 'footnote'").select("page_id", F.concat(s(F.col("book")), F.lit("-"), s(F.col("pos") - 2)).alias("anchor"), F.col("block_id").alias("note_id"), F.when(F.col("pos") % 2 == 0, 1.0).otherwise(0.6).alias("confidence"), F.lit("exact").alias("method"))
    refs = b.where("pos % 5 = 2").select("block_id", (F.col("pos") % 7).alias("book"), (F.length("text") % 9).alias("first"), (F.length("text") % 9 + 1).alias("last"), F.lit("exact").alias("status"))
    reports = b.where("type = 'hadith'").groupBy(F.concat(s(F.col("book")), F.lit("."), s(F.floor(F.col("pos") / 3))).alias("unit_id")).agg(F.collect_list("block_id").alias("block_ids"), F.lit("found").alias("status"), F.lit("sound").alias("grade"))
    out = reference.full_page_view(pages, b, links, refs, reports)
    listed = lambda name, one: F.array_join(F.transform(name, one), ",").alias(name)
    return out.select("book", "page_id", "before", "after", F.size("blocks").cast("long").alias("n_blocks"), listed("links", lambda x: F.concat(x.anchor, F.lit(">"), x.note_id, F.lit("@"), s(x.confidence))), listed("refs", lambda x: F.concat_ws(":", x.block_id, s(x.book), s(x["first"]))), listed("reports", lambda x: x.unit_id))


@query(f"""
WITH {_PAGES}, n AS (SELECT book, count(*) AS n_pages FROM p GROUP BY 1),
m AS (SELECT book, role AS key, max(left(text, 12)) AS value FROM bk WHERE text <> '' GROUP BY 1, 2)
SELECT n.book, n_pages, coalesce(string_agg(key || '=' || value, ';' ORDER BY key), '') AS meta FROM n LEFT JOIN m USING (book) GROUP BY 1, 2""")
def books_meta(spark, d):
    """Books with what is known about each."""
    b = blocks(spark, d)
    view = reference.book_view(b.select("book", F.floor(F.col("pos") / 4).alias("no"), "page_id").distinct())
    out = reference.with_meta(view, b.where("text <> ''").select("book", F.col("author_role").alias("key"), F.left("text", F.lit(12)).alias("value")))
    return out.select("book", "n_pages", F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("meta"))


@query(f"""
WITH {_BLOCKS}, ps AS (SELECT book AS qid, row_number() OVER (PARTITION BY book ORDER BY pos) AS place, text, page_id FROM bk WHERE type = 'hadith'),
c AS (SELECT qid, string_agg('P' || place || ' [main] (Book، p. ' || page_id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM ps GROUP BY 1),
v AS (SELECT book AS qid, row_number() OVER (PARTITION BY book ORDER BY pos) AS no, '(verse, outside the book) name ' || pos || ': ' || left(text, 40) || chr(10) || '    meaning: ' || CASE WHEN pos % 2 = 0 THEN '-' ELSE 'm' || pos END AS line FROM bk WHERE pos % 5 = 2),
t AS (SELECT book AS qid, row_number() OVER (PARTITION BY book ORDER BY pos) AS no, '(definition, outside the book) term ' || pos || ': ' || left(text, 20) || ' ' || CASE WHEN pos % 4 = 3 THEN chr(10) || '    English: en' || pos || ': ' ELSE '' END AS line FROM bk WHERE pos % 4 > 1 AND pos < 8),
i AS (SELECT qid, string_agg(line, chr(10) ORDER BY kind, no) AS outside FROM (SELECT qid, 0 AS kind, no, '[Q' || no || '] ' || line AS line FROM v UNION ALL SELECT qid, 1, no, '[T' || no || '] ' || line FROM t) GROUP BY 1),
tp AS (SELECT conv_id AS qid, list_distinct(list(CASE turn % 4 WHEN 1 THEN 'fiqh' WHEN 2 THEN 'history' WHEN 3 THEN 'other' END) FILTER (turn % 4 > 0)) AS topics FROM conversations GROUP BY 1)
SELECT tp.qid, md5(concat_ws(chr(10) || chr(10), context, outside)) AS digest, length(concat_ws(chr(10) || chr(10), context, outside)) AS n_chars,
  'doubts' || CASE WHEN list_contains(topics, 'history') THEN ',history' ELSE '' END || CASE WHEN list_contains(topics, 'fiqh') THEN ',fiqh' ELSE '' END AS referrals
FROM tp LEFT JOIN c USING (qid) LEFT JOIN i USING (qid) WHERE context IS NOT NULL OR outside IS NOT NULL""")
def answer_contexts(spark, d):
    """The whole context of a question: its passages, verses and terms from outside, and where it refers to."""
    from pyspark.sql import Window

    b = blocks(spark, d)
    w, s = Window.partitionBy("book").orderBy("pos"), lambda c: c.cast("string")
    ps = b.where("type = 'hadith'").select(F.col("book").alias("qid"), F.row_number().over(w).alias("place"), F.lit("matn").alias("kind"), F.array(F.lit("Book")).alias("crumbs"), F.array("page_id").alias("pages"), "text", F.array().cast("array<string>").alias("notes"))
    pos = F.col("pos")
    verses = b.where("pos % 5 = 2").select(F.col("book").alias("qid"), pos.alias("place"), F.concat(F.lit("name "), s(pos)).alias("name"), F.left("text", F.lit(40)).alias("words"), F.when(pos % 2 == 0, "").otherwise(F.concat(F.lit("m"), s(pos))).alias("meaning"))
    terms = b.where("pos % 4 > 1 and pos < 8").select(F.col("book").alias("qid"), pos.alias("place"), F.concat(F.lit("term "), s(pos)).alias("term"), F.left("text", F.lit(20)).alias("definition"), F.lit(None).cast("string").alias("explanation"), F.when(pos % 4 == 3, F.concat(F.lit("en"), s(pos))).alias("term_en"), F.lit(None).cast("string").alias("definition_en"))
    whole = gates.whole_context(gates.context_text(ps), gates.outside_items(verses, terms))
    k = F.col("turn") % 4
    topics = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.collect_set(F.when(k == 1, "fiqh").when(k == 2, "history").when(k == 3, "other")).alias("topics"))
    return whole.join(topics, "qid").select("qid", F.md5(F.encode("context", "UTF-8")).alias("digest"), F.length("context").cast("long").alias("n_chars"), F.array_join(gates.referrals(F.col("topics")), ",").alias("referrals"))


@query(f"""
WITH k AS (SELECT d.doc_id, d.lang, {key_sql('d.text')} AS key, l.quality, l.toxic, len(list_filter(string_split(coalesce(d.text, ''), ' '), lambda x: x <> '')) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) < doc_id AS cached FROM k)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN cached THEN 'cached' WHEN regexp_matches(key, '(^| )a[a-z]*e ') AND n < 60 THEN 'glossary' WHEN toxic = 1 THEN 'referral' WHEN lang = 'fr' AND n % 5 = 0 THEN 'unavailable' WHEN quality = 0 OR n < 12 THEN 'abstained' ELSE 'answered' END AS status FROM f) GROUP BY 1""")
def answer_states(spark, d):
    """Texts as questions in all six states: asked before, asking for a term, personal, without service, without support."""
    docs = table(spark, d, "documents").select("doc_id", "lang", N.latin_key(F.col("text")).alias("key"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).alias("n"))
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    rows = rows.join(first, "key")
    short = F.col("n") < 60
    signals = {
        "cached": F.col("first") < F.col("doc_id"), "glossary": F.col("key").rlike("(^| )a[a-z]*e ") & short, "referral": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "unavailable": (F.col("lang") == "fr") & (F.col("n") % 5 == 0), "abstained": F.coalesce(F.col("quality") == 0, F.lit(False)) | (F.col("n") < 12),
    }
    return rows.select(gates.status(signals).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_SCORES = f"""sc AS (SELECT turn % 3 AS run, conv_id AS qid, role AS behaviour, length(text) % 3 > 0 AS passed, CASE WHEN length(text) % 2 = 0 THEN contains(text, 'a') END AS cites_gold, length(text) % 4 = 1 AS unmet,
  len(text) - len(replace(text, 'e', '')) AS shown, len(text) - len(replace(text, 'z', '')) AS fabricated, len(text) - len(replace(text, 'o', '')) AS book, len(text) - len(replace(text, 'on', 'n')) AS traced FROM conversations WHERE turn < 6 AND turn % 2 = 0),
qs AS (SELECT DISTINCT conv_id AS qid, CASE WHEN conv_id % 3 = 0 THEN 'official' ELSE 'natural' END AS source, ['answer', 'abstain', 'refer', 'correct_verse'][CAST(conv_id % 4 + 1 AS INTEGER)] AS expected, conv_id % 5 = 0 AS required, conv_id % 2 = 0 AS asked_for FROM conversations),
j AS (SELECT * FROM sc JOIN qs USING (qid)), o AS (SELECT * FROM j WHERE run = 0)"""


@query(f"""
WITH {_SCORES}, r AS (
  SELECT 'passed' AS metric, count_if(passed) AS h, count(*) AS n FROM o
  UNION ALL SELECT 'answered_from_book', count_if(passed), count(*) FROM o WHERE source <> 'official' AND expected = 'answer'
  UNION ALL SELECT 'cites_gold', count_if(cites_gold), count(*) FROM o WHERE expected = 'answer' AND cites_gold IS NOT NULL
  UNION ALL SELECT 'abstained', count_if(passed), count(*) FROM o WHERE expected = 'abstain'
  UNION ALL SELECT 'referred', count_if(passed), count(*) FROM o WHERE expected = 'refer'
  UNION ALL SELECT 'verse_corrected', count_if(passed), count(*) FROM o WHERE expected = 'correct_verse'
  UNION ALL SELECT 'all_evidence', count_if(passed), count(*) FROM o WHERE required
  UNION ALL SELECT 'requirements_met', count_if(NOT unmet), count(*) FROM o WHERE asked_for
  UNION ALL SELECT 'quotes_verified', sum(shown) - sum(fabricated), sum(shown) FROM o
  UNION ALL SELECT 'quotes_traced', sum(traced), sum(book) FROM o
  UNION ALL SELECT 'consistent', count_if(k = 1), count(*) FROM (SELECT qid, count(DISTINCT behaviour) AS k FROM j GROUP BY 1 HAVING count(DISTINCT run) > 1 AND count_if(run = 0) > 0)
) SELECT metric, round(h / n::DOUBLE, 6) AS value, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""")
def class_report(spark, d):
    """Shares by class of question, over turns as answers of three runs."""
    c = table(spark, d, "conversations")
    size, count = F.length("text"), lambda x: (F.length("text") - F.length(F.replace("text", F.lit(x), F.lit(x[1:])))).cast("long")
    none = F.array().cast("array<string>")
    scores = c.where("turn < 6 and turn % 2 = 0").select((F.col("turn") % 3).alias("run"), F.col("conv_id").alias("qid"), F.col("role").alias("behaviour"), (size % 3 > 0).alias("passed"), F.when(size % 2 == 0, F.contains("text", F.lit("a"))).alias("cites_gold"), F.when(size % 4 == 1, F.array(F.lit("x"))).otherwise(none).alias("unmet"), count("e").alias("shown"), count("z").alias("fabricated"), count("o").alias("book"), count("on").alias("traced"))
    q = F.col("conv_id")
    kinds = F.element_at(F.array(*map(F.lit, ("answer", "abstain", "refer", "correct_verse"))), (q % 4 + 1).cast("int"))
    questions = c.select("conv_id").distinct().select(q.alias("qid"), F.when(q % 3 == 0, "official").otherwise("natural").alias("source"), kinds.alias("expected"), F.when(q % 5 == 0, F.array(F.lit("c"))).alias("required"), (q % 2 == 0).alias("asked_for"))
    return metrics.class_report(scores, questions, 0)


@query(f"""
WITH b AS (SELECT item_id, {words_sql()} AS w FROM benchmark), dc AS (SELECT doc_id, {key_sql()} AS hay, {words_sql()} AS w FROM documents),
q AS (
  SELECT item_id AS qid, 'book' AS kind, item_id AS tag, array_to_string(w[2:6], ' ') AS key FROM b
  UNION ALL SELECT item_id, 'book', item_id + 1, array_to_string(w[3:5], ' ') FROM b WHERE item_id % 3 = 0
  UNION ALL SELECT item_id, 'book', item_id, array_to_string(w[2:4], ' ') || ' zzz' FROM b WHERE item_id % 4 = 1
  UNION ALL SELECT b.item_id, 'external', b.item_id, array_to_string(dc.w[1:4], ' ') FROM b JOIN dc ON dc.doc_id = b.item_id WHERE b.item_id % 4 = 0
), s AS (SELECT 'book' AS kind, item_id AS tag, array_to_string(w, ' ') AS hay, item_id % 2 = 0 AS placed FROM b WHERE item_id % 5 <> 3 UNION ALL SELECT 'external', doc_id, hay, NULL FROM dc),
h AS (SELECT q.*, coalesce(key <> '' AND contains(' ' || hay || ' ', ' ' || key || ' '), false) AS held, placed FROM q LEFT JOIN s ON s.kind = q.kind AND s.tag = q.tag)
SELECT qid, count(*) AS shown, count_if(held) AS verified, count_if(kind = 'book') AS book, count_if(kind = 'external') AS external, count_if(held AND kind = 'book' AND coalesce(placed, false)) AS traced FROM h GROUP BY 1""")
def rechecked_quotes(spark, d):
    """Shown quotes of passages and documents, each looked up again in its own source."""
    b = table(spark, d, "benchmark").select("item_id", T.words(N.latin_key(F.col("text"))).alias("w"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("tag"), N.latin_key(F.col("text")).alias("hay"))
    i, cut = F.col("item_id"), lambda a, n: F.array_join(F.slice("w", a, n), " ")
    book = lambda rows, tag, key: rows.select(i.alias("qid"), F.lit("book").alias("kind"), tag.alias("tag"), key.alias("key"))
    outside = b.where(i % 4 == 0).join(docs, i == F.col("tag")).select(i.alias("qid"), F.lit("external").alias("kind"), "tag", F.array_join(F.slice(T.words(F.col("hay")), 1, 4), " ").alias("key"))
    quotes = book(b, i, cut(2, 5)).unionByName(book(b.where(i % 3 == 0), i + 1, cut(3, 3))).unionByName(book(b.where(i % 4 == 1), i, F.concat(cut(2, 3), F.lit(" zzz")))).unionByName(outside)
    sources = b.where(i % 5 != 3).select(F.lit("book").alias("kind"), i.alias("tag"), F.array_join("w", " ").alias("hay"), (i % 2 == 0).alias("placed"))
    sources = sources.unionByName(docs.select(F.lit("external").alias("kind"), "tag", "hay", F.lit(None).cast("boolean").alias("placed")))
    return gates.recheck(quotes, sources)


_FULL = "".join(chr(ord(c) + 0xFEE0) for c in LATIN)


@query(rf"""
WITH s AS (SELECT item_id, {scribe_sql()} AS t FROM benchmark), w AS (SELECT item_id, coalesce(list_filter(string_split(t, ' '), lambda x: x <> '')[1], '') AS one, t FROM s)
SELECT item_id, md5({search_sql('lower(text)')}) AS wide_key, md5({search_sql("regexp_replace(t || ' (12) x¹', '" + LONG_MARKER + "', ' ', 'g')")}) AS quote, {search_sql('one')} AS token, translate('page ' || item_id, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits, md5(nfc_normalize(text || 'e' || chr(769))) AS composed
FROM w JOIN benchmark USING (item_id)""")
def compat_keys(spark, d):
    """Keys that need Unicode forms: full-width letters, superscripts, split accents; quote and token keys; printed digits."""
    text = scribe(F.col("text"))
    one = F.coalesce(F.get(F.filter(F.split(text, " "), lambda x: x != ""), F.lit(0)), F.lit(""))
    b = table(spark, d, "benchmark")
    wide = F.translate(F.lower("text"), LATIN, _FULL)
    return b.select("item_id", F.md5(F.encode(N.normalize(wide), "UTF-8")).alias("wide_key"), F.md5(F.encode(N.quote_key(F.concat(text, F.lit(" (12) x¹"))), "UTF-8")).alias("quote"), N.token_key(one).alias("token"), N.arabic_digits(F.concat(F.lit("page "), F.col("item_id").cast("string"))).alias("digits"), F.md5(F.encode(N.unicode_form(F.concat("text", F.lit("e\u0301")), "NFC"), "UTF-8")).alias("composed"))


def _embed(texts):
    """A stand-in for a model: counts of a few letters."""
    return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


@query("SELECT doc_id AS id, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'a', '')) AS a FROM documents")
def embedded_texts(spark, d):
    """A vector for every document, asked for once for each distinct text and kept for later runs."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = retrieval.embedded(docs, _embed, scratch_path(spark, "vectors"))
    return v.select("id", *[F.col("vec")[k].cast("long").alias(n) for k, n in enumerate(("n", "e", "a"))])
