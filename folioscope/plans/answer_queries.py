"""Queries on answers, caches, budgets, reviews and scores. Orders stand for answers, events for calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import alignment, fuzzy, gates, metrics, reference, review
from folioscope.sources.io import as_timestamp, table

from .key_queries import content_sql, scribe, scribe_sql
from .layout_queries import _PIECES, pieces
from .registry import key_sql, registry, words_sql

QUERIES, ORACLES, query = registry()


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"


@query(f"""
WITH i AS (SELECT 'T' || item_id AS tag, CASE WHEN item_id % 2 = 0 THEN 'term' ELSE 'quran' END AS kind, 'name' || item_id AS term, {key_sql()} AS words, 'note of it' AS note FROM benchmark WHERE item_id % 7 <> 3),
w AS (SELECT item_id, {words_sql()} AS w FROM benchmark),
q AS (SELECT item_id AS qid, 'T' || (item_id - item_id % 2) AS tag, CASE item_id % 3 WHEN 0 THEN 'name' || (item_id - item_id % 2) || ': ' || array_to_string(w[2:5], ' ') WHEN 1 THEN array_to_string(w[2:2], ' ') ELSE 'note of' END AS quote FROM w),
b AS (SELECT q.*, words, note, kind, CASE WHEN kind = 'term' THEN regexp_replace(quote, '^\\s*' || coalesce(term, '') || '\\s*:\\s*', '') ELSE quote END AS bare FROM q LEFT JOIN i USING (tag))
SELECT qid, tag, coalesce(kind IS NOT NULL AND len(string_split(trim(regexp_replace(bare, '[^a-z0-9]+', ' ', 'g')), ' ')) >= 2 AND contains(' ' || words || ' ' || note || ' ', ' ' || trim(regexp_replace(bare, '[^a-z0-9]+', ' ', 'g')) || ' '), false) AS kept FROM b""")
def external_quotes(spark, d):
    """Quotes of approved items outside the book: two words at least, word for word, without a term's own label."""
    b = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("key")).withColumn("w", T.words(F.col("key")))
    i = F.col("item_id")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    items = b.where(i % 7 != 3).select(name("T", i).alias("tag"), F.when(i % 2 == 0, "term").otherwise("quran").alias("kind"), name("name", i).alias("term"), F.col("key").alias("words"), F.lit("note of it").alias("note"))
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    quote = F.when(i % 3 == 0, F.concat(name("name", i - i % 2), F.lit(": "), cut(2, 4))).when(i % 3 == 1, cut(2, 1)).otherwise(F.lit("note of"))
    quotes = b.select(i.alias("qid"), name("T", i - i % 2).alias("tag"), quote.alias("quote"))
    return gates.verify_external(quotes, items, stable=True).select("qid", "tag", "kept")


@query(f"WITH {_O} SELECT k, CASE c % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END IN ('A', 'B') AND c % 5 > 0 AND NOT k % 3 = 0 AND coalesce(CASE WHEN k % 7 > 0 THEN c % 100 / 100.0::DOUBLE END, 0) < 0.65 AS external FROM o")
def external_gate(spark, d):
    """May verses from outside the book be shown?"""
    k, c = F.col("k"), F.col("c")
    level = F.element_at(F.array(*map(F.lit, "ABCD")), (c % 4 + 1).cast("int"))
    best = F.when(k % 7 > 0, c % 100 / F.lit(100.0))
    return orders(spark, d).select("k", gates.external_allowed(level, k % 3 == 0, c % 5 > 0, best).alias("external"))


@query(r"""
WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text || ' See P1. Not Q9! As P2 and T3 say. End', '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(len(list_filter(p, lambda s: len(list_filter(regexp_extract_all(s, '[PQT][0-9]+'), lambda t: t NOT IN ('P1', 'P2', 'T3'))) = 0)) AS BIGINT) AS n_kept, CAST(len(p) AS BIGINT) AS n FROM s""")
def explained(spark, d):
    """Sentences that cite no unknown source."""
    parts = T.sentences(F.concat("text", F.lit(" See P1. Not Q9! As P2 and T3 say. End")))
    kept = gates.keep_explained(parts, F.array(F.lit("P1"), F.lit("P2"), F.lit("T3")))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(kept).cast("long").alias("n_kept"), F.size(parts).cast("long").alias("n"))


@query(f"""
WITH w AS (SELECT item_id, list_transform({words_sql()}[1:3], lambda x: {scribe_sql('x')}) AS a FROM benchmark),
o AS (SELECT item_id, array_to_string(a, ' ') AS p, CASE item_id % 3 WHEN 0 THEN 'ان و' || array_to_string(a, ' و') WHEN 1 THEN array_to_string(a, ' ') || ' ثم' ELSE array_to_string(a, ' ') || ' ' || a[1] END AS r FROM w WHERE len(a) = 3)
SELECT item_id, {content_sql('p')} = {content_sql('r')} AS same FROM o""")
def function_words(spark, d):
    """Do two wordings differ in function words alone?"""
    rows = table(spark, d, "benchmark").select("item_id", F.transform(F.slice(T.words(N.latin_key(F.col("text"))), 1, 3), scribe).alias("a")).where(F.size("a") == 3)
    p = F.array_join("a", " ")
    r = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("ان و"), F.array_join("a", " و"))).when(F.col("item_id") % 3 == 1, F.concat(p, F.lit(" ثم"))).otherwise(F.concat(p, F.lit(" "), F.col("a")[0]))
    op = F.struct(F.split(p, " ").alias("printed"), F.split(r, " ").alias("reference"))
    return rows.select("item_id", gates.function_words_only(F.array(op)).alias("same"))


@query(f"""
WITH q AS (SELECT item_id AS qid, {key_sql()} AS key FROM benchmark), k AS (SELECT qid, substr(sha256('v1|p|' || key), 1, 24) AS key FROM q),
c AS (SELECT key, min('answer ' || qid) AS answer FROM k WHERE qid % 3 = 0 GROUP BY 1)
SELECT k.qid, k.key, c.answer FROM k LEFT JOIN c USING (key)""")
def answer_cache(spark, d):
    """Stored answers by the key of version, prompt and question."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), N.latin_key(F.col("text")).alias("qkey"))
    key = lambda df: gates.answer_key(F.lit("v1"), F.lit("p"), df)
    cache = q.where("qid % 3 = 0").select(key(F.col("qkey")).alias("key"), F.concat(F.lit("answer "), F.col("qid").cast("string")).alias("answer")).groupBy("key").agg(F.min("answer").alias("answer"))
    return gates.cached_answers(q, cache, F.lit("v1"), F.lit("p"), F.col("qkey")).select("qid", "key", "answer")


@query(f"WITH {_O} SELECT k, substr(sha256(CAST(encode('m' || c) || '\\x00'::BLOB || encode('prompt') || '\\x00'::BLOB || encode('' || k) AS BLOB)), 1, 32) AS key FROM o")
def call_keys(spark, d):
    """Keys of model calls: parts apart by NUL."""
    return orders(spark, d).select("k", gates.call_key(F.concat(F.lit("m"), F.col("c").cast("string")), F.lit("prompt"), F.col("k").cast("string")).alias("key"))


@query("""
WITH p AS (SELECT o_custkey AS qid, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
t AS (SELECT *, 'P' || place || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '[editor]' ELSE '[main]' END || ' (Book › Part' || o_orderkey % 4 || '، p. ' || o_orderkey % 90 || ')' || chr(10) || 'text ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '[notes] n' || o_orderkey ELSE '' END AS one FROM p WHERE place <= 5)
SELECT qid, string_agg(one, chr(10) || chr(10) ORDER BY place) AS context FROM t GROUP BY 1""")
def contexts(spark, d):
    """Passages as the numbered context of a question."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"), F.when(k % 3 == 0, "editor_commentary").otherwise("matn").alias("kind"), F.array(F.lit("Book"), F.concat(F.lit("Part"), s(k % 4))).alias("crumbs"), F.array(k % 90).alias("pages"), F.concat(F.lit("text "), s(k)).alias("text"), F.when(k % 2 == 0, F.array(F.concat(F.lit("n"), s(k)))).otherwise(F.array().cast("array<string>")).alias("notes"))
    return gates.context_text(rows.where("place <= 5"))


@query(f"""
WITH {_O}, i AS (SELECT c % 40 AS page, CASE WHEN k % 3 > 0 THEN 'x' END AS decision FROM o WHERE k % 2 = 0), s AS (SELECT c % 45 AS page, CASE k % 4 WHEN 1 THEN 'ok' WHEN 3 THEN 'wrong' END AS verdict FROM o WHERE k % 2 = 1),
a AS (SELECT page, count(*) AS items_total, count(decision) AS items_done FROM i GROUP BY 1), b AS (SELECT page, count(*) AS spot_total, count(verdict) AS spot_done, count_if(verdict = 'wrong') AS spot_wrong FROM s GROUP BY 1)
SELECT coalesce(a.page, b.page) AS page, coalesce(items_total, 0) AS items_total, coalesce(items_done, 0) AS items_done, coalesce(spot_total, 0) AS spot_total, coalesce(spot_done, 0) AS spot_done, CAST(coalesce(spot_wrong, 0) AS BIGINT) AS spot_wrong FROM a FULL JOIN b ON a.page = b.page""")
def review_progress(spark, d):
    """How far the review of each page is."""
    o, k, c = orders(spark, d), F.col("k"), F.col("c")
    items = o.where(k % 2 == 0).select((c % 40).alias("page"), F.when(k % 3 > 0, "x").alias("decision"))
    spots = o.where(k % 2 == 1).select((c % 45).alias("page"), F.when(k % 4 == 1, "ok").when(k % 4 == 3, "wrong").alias("verdict"))
    return review.progress(items, spots)


@query(f"WITH {_O} SELECT count(*) AS reviewed, CAST(count_if(k % 4 = 0) AS BIGINT) AS approve, CAST(count_if(k % 4 = 1) AS BIGINT) AS edit, CAST(count_if(k % 4 = 2) AS BIGINT) AS remove, CAST(count_if(c % 3 = 0) AS BIGINT) AS with_notes FROM o")
def review_actions(spark, d):
    """Counts of reviews by action."""
    k = F.col("k")
    rows = orders(spark, d).select(F.when(k % 4 == 0, "approve").when(k % 4 == 1, "edit").when(k % 4 == 2, "remove").otherwise("skip").alias("action"), F.when(F.col("c") % 3 == 0, "n").otherwise("").alias("note"))
    return review.action_counts(rows)


@query("""
WITH e AS (SELECT user_id, round(sum(CASE WHEN event_type <> 'view' THEN coalesce(value, 0) END), 2) AS total, round(sum(CASE WHEN event_id % 3 = 0 THEN coalesce(value, 0) ELSE 0 END), 2) AS today FROM events GROUP BY 1),
s AS (SELECT user_id, coalesce(total, 0) AS total, today, greatest(coalesce(total, 0) + 5, coalesce(CASE WHEN user_id % 2 = 0 THEN user_id * 10.0 END, 0)) AS spent FROM e)
SELECT user_id, round(spent, 4)::DOUBLE AS spent, round(spent / 500, 4)::DOUBLE AS share, spent >= 400 AS warn, spent >= 450 AS stop, spent >= 420 AS eval_stop, CASE WHEN spent >= 450 THEN NULL WHEN today >= 60 THEN 'fallback' ELSE 'main' END AS model FROM s""")
def budgets(spark, d):
    """Spending against a budget, and the model that it leaves."""
    cost = F.coalesce("value", F.lit(0.0))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") != "view", cost)), 2).alias("total"), F.round(F.sum(F.when(F.col("event_id") % 3 == 0, cost).otherwise(F.lit(0.0))), 2).alias("today"))
    rows = rows.withColumn("total", F.coalesce("total", F.lit(0.0)))
    state = reference.budget_status(F.col("total"), F.lit(5.0), F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 10.0), 500.0, 450.0, 30.0)
    rows = rows.withColumns(state)
    return rows.select("user_id", *state, review.choose_model(F.col("spent"), F.col("today"), 450.0, 60.0).alias("model"))


@query("""
SELECT round(coalesce(sum(coalesce(value, 0)), 0), 2) AS spent FROM events WHERE event_id % 4 <> 0 AND starts_with(event_type, 'c') AND CAST(ts AS TIMESTAMP) >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events)""")
def spending(spark, d):
    """The cost of calls of one kind since the second day; cached ones cost nothing."""
    e = as_timestamp(table(spark, d, "events"))
    start = e.agg((F.date_trunc("DAY", F.min("ts")) + F.expr("INTERVAL 1 DAY")).alias("t")).first().t
    rows = e.select("ts", F.col("event_type").alias("stage"), (F.col("event_id") % 4 == 0).alias("cached"), F.col("value").alias("cost_usd"))
    return review.spend(rows, F.lit(start).cast("timestamp"), "c").select(F.round("spent", 2).alias("spent"))


@query(f"""
WITH {_O}, a AS (SELECT k, CASE k % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'approve' WHEN 2 THEN 'edit' END AS action FROM o)
SELECT o.k, CASE WHEN action = 'edit' THEN 'new' ELSE 'q' || o.c END AS question, coalesce(action IN ('approve', 'edit'), false) AS verified FROM o JOIN a USING (k) WHERE coalesce(action <> 'remove', true)""")
def decided_questions(spark, d):
    """Reviewers' decisions merged over drafts."""
    o, k = orders(spark, d), F.col("k")
    drafts = o.select("k", F.concat(F.lit("q"), F.col("c").cast("string")).alias("question"))
    decisions = o.where(k % 5 < 3).select("k", F.when(k % 5 == 0, "remove").when(k % 5 == 1, "approve").otherwise("edit").alias("action"), F.lit("new").alias("value"))
    return review.decide(drafts, decisions, "k", "question").select("k", "question", "verified")


@query("""
WITH b AS (SELECT l_orderkey AS chunk, l_linenumber AS pos, l_partkey AS block FROM lineitem), f AS (SELECT block, min(chunk) AS chunk FROM b GROUP BY 1),
a AS (SELECT o_custkey AS qid, o_orderkey % 150 AS block FROM orders)
SELECT DISTINCT qid, f.chunk FROM a JOIN f USING (block)""")
def anchored_chunks(spark, d):
    """The chunks that a question's blocks are in now."""
    chunks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_list("l_partkey").alias("block_ids"))
    anchors = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 150).alias("block_id"))
    return reference.anchors_to_chunks(anchors, chunks)


@query(f"""
WITH {_PIECES}, b AS (SELECT page AS chunk, ord AS pos, part AS block, part % 4 = 0 AS is_unit FROM pc)
SELECT chunk, block AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY NOT is_unit, pos) AS k FROM b) WHERE k = 1""")
def chunk_anchors(spark, d):
    """A chunk's first block of the unit's type, else its first."""
    # A chunk's first block is a least value, so its blocks are neither numbered nor listed.
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), order.alias("pos"), F.col("l_partkey").alias("block_id"))
    kinds = rows.select("block_id", F.when(F.col("block_id") % 4 == 0, "hadith").otherwise("body").alias("type")).distinct()
    return reference.chunk_anchors(rows, kinds)


_NOTES = f"nb AS (SELECT item_id // 8 AS page, item_id AS ord, CASE WHEN item_id % 3 > 0 THEN CAST(item_id % 5 + 1 AS VARCHAR) END AS marker, {words_sql()} AS w FROM benchmark)"


@query(f"""
WITH {_NOTES}, l AS (SELECT *, row_number() OVER (PARTITION BY page, marker ORDER BY ord DESC) AS k FROM nb WHERE marker IS NOT NULL)
SELECT page, marker, array_to_string(w[1:3], ' ') AS head FROM l WHERE k = 1""")
def note_links(spark, d):
    """Notes as marker and first three words; the last of a marker counts."""
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(F.floor(i / 8).alias("page"), i.alias("ord"), F.when(i % 3 > 0, F.concat(F.lit("("), (i % 5 + 1).cast("string"), F.lit(")"))).alias("m"), N.latin_key(F.col("text")).alias("key"))
    return reference.note_links(rows, N.normalize_marker(F.col("m")), F.col("key"))


@query(f"""
WITH {_PIECES}, b AS (SELECT page, ord, CASE WHEN part % 2 = 0 THEN 'footnote' ELSE 'body' END AS type, CASE WHEN supp % 4 > 0 THEN CAST(supp % 9 AS INTEGER) END AS num FROM pc)
SELECT page, ord, CAST(row_number() OVER (PARTITION BY page ORDER BY type = 'footnote', CASE WHEN type = 'footnote' THEN coalesce(num, 999) ELSE 0 END, ord) AS BIGINT) AS seq FROM b""")
def layout_order(spark, d):
    """Main text in its order, then notes by number."""
    rows = pieces(spark, d).select("page", "ord", F.when(F.col("part") % 2 == 0, "footnote").otherwise("body").alias("type"), F.when(F.col("supp") % 4 > 0, (F.col("supp") % 9).cast("int")).alias("number"))
    return metrics.by_marker(rows).select("page", "ord", F.col("seq").cast("long").alias("seq"))


@query(f"""
WITH {_PIECES}, n AS (SELECT page, ord, supp % 9 AS num FROM pc WHERE supp % 4 > 0), p AS (SELECT *, coalesce(num >= lag(num) OVER (PARTITION BY page ORDER BY ord), true) AS ok FROM n)
SELECT page, bool_and(ok) AS sorted FROM p GROUP BY 1""")
def notes_in_order(spark, d):
    """Do the notes of a page come in the order of their numbers?"""
    rows = pieces(spark, d).where("supp % 4 > 0").select("page", "ord", (F.col("supp") % 9).alias("num"))
    return metrics.in_order(rows, "page", "ord", "num")


@query(f"""
WITH r AS (SELECT vec_id AS qid, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, 'c' || vec_id AS id FROM embeddings),
s AS (SELECT label AS qid, id, rank FROM r), g AS (SELECT label AS qid, 'c' || vec_id AS id FROM embeddings WHERE vec_id % 9 = 4),
h AS (SELECT DISTINCT g.qid FROM g JOIN s ON s.qid = g.qid AND s.id = g.id AND rank <= 5)
SELECT DISTINCT g.qid, g.qid IN (SELECT qid FROM h) AS chunk_hit, g.qid IN (SELECT n.qid FROM (SELECT label AS qid, vec_id % 7 AS need FROM embeddings) n JOIN s ON s.qid = n.qid WHERE rank <= 5 AND rank % 2 = 0 AND contains(s.id, '' || n.need)) AS complete FROM g""")
def context_hits(spark, d):
    """Is a gold chunk among the first five, and does a shown unit of a gold page hold a needed note?"""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("qid"))
    ranked = e.select("qid", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"), F.row_number().over(Window.partitionBy("qid").orderBy("vec_id")).alias("rank"))
    gold = e.where("vec_id % 9 = 4").select("qid", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"))
    shown = ranked.where("rank <= 5").select("qid", F.col("id").alias("key"), (F.col("rank") % 2 == 0).alias("gold"))
    needs = e.select("qid", (F.col("vec_id") % 7).cast("string").alias("need")).distinct()
    return metrics.chunk_hits(ranked, gold).join(metrics.context_complete(shown, needs), "qid")


@query("SELECT source AS system, round(avg(n_chars), 6) AS n_chars, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS english FROM documents GROUP BY 1")
def system_means(spark, d):
    """Unweighted means by system."""
    rows = table(spark, d, "documents").select(F.col("source").alias("system"), "n_chars", F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("english"))
    return metrics.macro_means(rows, "system", ["n_chars", "english"])


@query("""
WITH e AS (SELECT event_id, event_type AS model, event_id % 900 AS i, user_id % 300 AS o, CASE WHEN event_id % 3 = 0 THEN value END AS c FROM events WHERE event_id % 5 <> 0), p AS (SELECT * FROM (VALUES ('click', 4.0, 20.0), ('view', 10.0, 50.0)) v(model, a, b))
SELECT model, count(*) AS n, round(avg(coalesce(c, (i * a + o * b) / 1e6, 0)), 6) AS cost FROM e LEFT JOIN p USING (model) GROUP BY 1""")
def call_costs(spark, d):
    """Mean cost of a call: reported, else tokens by price; retries are left out."""
    e = table(spark, d, "events")
    rows = e.select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 900).alias("input_tokens"), (F.col("user_id") % 300).alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("cost_usd"), F.when(F.col("event_id") % 5 == 0, "v1-retry").otherwise("v1").alias("prompt_version"))
    prices = spark.createDataFrame([("click", 4.0, 20.0), ("view", 10.0, 50.0)], "model string, input_price double, output_price double")
    return metrics.call_cost(rows, prices).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 6).alias("cost"))


@query(f"""
WITH {_O}, s AS (
  SELECT k AS qid, c % 5 AS book, unnest(range(k % 4, k % 4 + c % 3 + 1)) AS no FROM o WHERE k % 2 = 0
  UNION SELECT k, c % 5, k % 9 FROM o WHERE k % 3 = 0
  UNION SELECT k, c % 6, unnest(range(c % 4, c % 4 + k % 2 + 1)) FROM o WHERE k % 5 = 0)
SELECT DISTINCT qid, book || ':' || no AS verse FROM s""")
def shown_verses(spark, d):
    """Verses that a reader of an answer sees, from three places."""
    o, k, c = orders(spark, d), F.col("k"), F.col("c")
    span = lambda rows, book, a, n: rows.select(k.alias("qid"), book.alias("book"), a.alias("first"), (a + n).alias("last"))
    return metrics.shown_verses(span(o.where(k % 2 == 0), c % 5, k % 4, c % 3), o.where(k % 3 == 0).select(k.alias("qid"), (c % 5).alias("book"), (k % 9).alias("no")), span(o.where(k % 5 == 0), c % 6, c % 4, k % 2))


@query(f"""
WITH {_O}, a AS (SELECT k, CASE k % 5 WHEN 0 THEN 'answered' WHEN 1 THEN 'glossary' WHEN 2 THEN 'referral' WHEN 3 THEN 'abstained' END AS status, ['answer', CASE WHEN c % 2 = 0 THEN 'refer' ELSE 'abstain' END] AS allowed, c % 6 AS shown, greatest(c % 6 - k % 2, 0) AS verified,
  ['c' || c % 4, 'c' || k % 4] AS cited, CASE WHEN k % 3 = 0 THEN ['c' || c % 3] END AS gold, CASE WHEN k % 4 = 0 THEN ['c0', 'c' || c % 2] END AS required, k % 11 = 0 AS unmet, k % 13 = 0 AS wanted, k % 26 = 0 AS ok FROM o),
b AS (SELECT *, CASE status WHEN 'referral' THEN 'refer' WHEN 'abstained' THEN 'abstain' WHEN 'answered' THEN 'answer' WHEN 'glossary' THEN 'answer' ELSE coalesce(status, 'error') END AS behaviour FROM a)
SELECT k, behaviour, CAST(shown - verified AS BIGINT) AS fabricated, CASE WHEN gold IS NOT NULL AND status = 'answered' THEN list_has_any(gold, cited) END AS cites_gold,
  CASE WHEN required IS NOT NULL AND behaviour = 'answer' THEN round(len(list_distinct(list_filter(required, lambda x: list_contains(cited, x)))) / len(required)::DOUBLE, 6) END AS required_cited,
  CASE WHEN wanted THEN ok ELSE list_contains(allowed, behaviour) END AND (behaviour <> 'answer' OR len(list_filter(coalesce(required, []), lambda x: NOT list_contains(cited, x))) = 0) AND NOT unmet AS pass FROM b""")
def answer_scores(spark, d):
    """Did an answer behave as allowed, quote only what is there, and cite what it had to?"""
    k, c = F.col("k"), F.col("c")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rows = orders(spark, d).select(
        "k", F.when(k % 5 == 0, "answered").when(k % 5 == 1, "glossary").when(k % 5 == 2, "referral").when(k % 5 == 3, "abstained").alias("status"), F.array(F.lit("answer"), F.when(c % 2 == 0, "refer").otherwise("abstain")).alias("allowed"),
        (c % 6).alias("shown"), F.greatest(c % 6 - k % 2, F.lit(0)).alias("verified"), F.array(name(c % 4), name(k % 4)).alias("cited"), F.when(k % 3 == 0, F.array(name(c % 3))).alias("gold"), F.when(k % 4 == 0, F.array(F.lit("c0"), name(c % 2))).alias("required"),
        F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unmet"), (k % 13 == 0).alias("verse_wanted"), (k % 26 == 0).alias("verse_ok"),
    )
    return metrics.score_answers(rows).select("k", "behaviour", F.col("fabricated").cast("long").alias("fabricated"), "cites_gold", "required_cited", "pass")


@query(f"""
WITH {_O}, r AS (SELECT k, c, list_concat(
  list_transform(list_filter(CASE WHEN k % 3 = 0 THEN ['n1', 'n' || c % 4] ELSE []::VARCHAR[] END, lambda x: x NOT IN ('n1', 'n2')), lambda x: 'note not quoted: ' || x),
  CASE WHEN k % 4 = 0 AND 'n' || c % 5 NOT IN ('n1', 'n2') THEN ['none of the notes quoted'] ELSE [] END,
  CASE WHEN k % 5 = 0 AND NOT contains('one two three', 'w' || c % 2) THEN ['missing quote: w' || c % 2] ELSE [] END,
  CASE WHEN k % 2 = 0 AND '2:' || c % 3 <> '2:1' THEN ['verse not shown: 2:' || c % 3] ELSE [] END,
  CASE WHEN k % 6 = 0 AND c % 2 = 0 THEN ['closest verse not marked'] ELSE [] END,
  CASE WHEN k % 7 = 0 AND c % 3 > 0 THEN ['no outside verse cited'] ELSE [] END,
  CASE WHEN k % 8 = 0 AND c % 2 = 1 THEN ['term not cited: t1'] ELSE [] END,
  CASE WHEN k % 9 = 0 AND c % 3 > 0 THEN ['referral not shown: u'] ELSE [] END,
  CASE WHEN k % 10 = 0 AND c % 10 < 5 THEN ['explanation not in English'] ELSE [] END,
  CASE WHEN k % 11 = 0 AND c % 4 > 0 THEN ['English term missing: Fast'] ELSE [] END,
  CASE WHEN k % 12 = 0 AND c % 3 = 0 THEN ['no brief explanation'] ELSE [] END) AS unmet FROM o)
SELECT k, array_to_string(unmet, '; ') AS unmet FROM r""")
def requirements(spark, d):
    """A question's unmet requirements, of all eleven kinds."""
    k, c = F.col("k"), F.col("c")
    s = lambda x: x.cast("string")
    some = lambda cond, *x: F.when(cond, F.array(*x))
    n = lambda x: F.concat(F.lit("n"), s(x))
    req = {
        "footnotes_all": some(k % 3 == 0, F.lit("n1"), n(c % 4)), "footnotes_any": some(k % 4 == 0, n(c % 5)), "quotes_all": some(k % 5 == 0, F.concat(F.lit("w"), s(c % 2))), "verses_shown_all": some(k % 2 == 0, F.concat(F.lit("2:"), s(c % 3))),
        "closest_verse": F.when(k % 6 == 0, F.lit("2:1")), "external_quran": k % 7 == 0, "terms_cited_all": some(k % 8 == 0, F.lit("t1")), "referrals_all": some(k % 9 == 0, F.lit("u")),
        "language": F.when(k % 10 == 0, "en"), "terms_en_all": some(k % 11 == 0, F.lit("Fast")), "glossary_explanation": k % 12 == 0,
    }
    none = F.array().cast("array<string>")
    seen = {
        "notes": F.array(F.lit("n1"), F.lit("n2")), "quotes": F.array(F.lit("one two three")), "verses": F.array(F.lit("2:1")), "closest": F.when(c % 2 == 1, F.array(F.lit("2:1"))).otherwise(none), "quran": c % 3 == 0,
        "terms": F.when(c % 2 == 0, F.array(F.lit("t1"))).otherwise(none), "external": c % 3 == 0, "urls": F.array(F.lit("u")), "english_share": (c % 10) / F.lit(10.0), "blob": F.when(c % 4 == 0, "a FAST day").otherwise("a day"), "explanation": F.when(c % 3 > 0, "x").otherwise(""),
    }
    rows = orders(spark, d).withColumn("req", F.struct(*[v.alias(n) for n, v in req.items()]))
    return rows.select("k", F.array_join(metrics.requirement_rules(F.col("req"), seen), "; ").alias("unmet"))


@query(f"""
WITH k AS (SELECT item_id, {key_sql()} AS t FROM benchmark), w AS (SELECT item_id, t, array_to_string(string_split(t, ' ')[2:6], ' ') AS five FROM k),
n AS (SELECT item_id, t, CASE WHEN item_id % 3 = 0 THEN five ELSE left(five, 4) || 'q' || substr(five, 6) END AS p FROM w WHERE length(five) BETWEEN 10 AND 120),
o AS (SELECT a.item_id AS id, b.item_id AS other, a.p, b.t, length(a.p) AS m, length(b.t) AS n FROM n a JOIN k b ON b.item_id BETWEEN a.item_id AND a.item_id + 2 WHERE length(b.t) > length(a.p)),
mk AS (SELECT id, other, map_from_entries(list(struct_pack(k := c, v := bits))) AS masks FROM (SELECT id, other, c, sum(1::HUGEINT << i) AS bits FROM (SELECT id, other, unnest(string_split(p, '')) AS c, unnest(range(0, m))::INTEGER AS i FROM o) GROUP BY 1, 2, 3) GROUP BY 1, 2),
x AS (SELECT o.*, masks, unnest(range(2 - m, n + 1)) AS s FROM o JOIN mk USING (id, other)),
y AS (SELECT id, other, m, masks, (1::HUGEINT << m::INTEGER) - 1 AS whole, string_split(substr(t, greatest(s, 1), least(s + m, n + 1) - greatest(s, 1)), '') AS chars FROM x),
z AS (SELECT id, other, m, len(chars) AS l, m - bit_count(list_reduce(list_transform(chars, lambda c: coalesce(masks[c], 0::HUGEINT)), lambda r, c: ((r + (r & c)) | (r - (r & c))) & whole, whole)) AS lcs FROM y)
SELECT id, other, round(max(200.0::DOUBLE * lcs / (m + l)), 6) AS score FROM z GROUP BY 1, 2""")
def title_scores(spark, d):
    """The best place of a title, with a typo or without, in its own passage and the next two."""
    rows = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("t"))
    five = F.array_join(F.slice(F.split("t", " "), 2, 5), " ")
    title = F.when(F.col("item_id") % 3 == 0, F.col("five")).otherwise(F.concat(F.substring("five", 1, 4), F.lit("q"), F.substring(F.col("five"), F.lit(6), F.length("five"))))
    a = rows.withColumn("five", five).where(F.length("five").between(10, 120)).select(F.col("item_id").alias("id"), title.alias("p")).withColumn("other", F.explode(F.sequence("id", F.col("id") + 2)))
    pairs = a.join(rows.withColumnRenamed("item_id", "other"), "other").where(F.length("t") > F.length("p"))
    return pairs.select("id", "other", F.round(fuzzy.partial_ratio(F.col("p"), F.col("t")), 6).alias("score"))


@query()
def wording_scores(spark, d):
    """How alike two wordings are: shared words, and the best window."""
    rows = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("a"))
    rows = rows.withColumn("b", F.array_join(F.slice(F.split("a", " "), 3, 8), " "))
    ops = alignment.matched_words(F.split("b", " "), F.split("a", " "))
    return rows.select("item_id", F.round(fuzzy.token_set_ratio(F.col("a"), F.col("b")), 2).alias("token_set"), F.round(fuzzy.partial_ratio(F.col("a"), F.col("b")), 2).alias("part"), F.size(ops).alias("n_matched"))
