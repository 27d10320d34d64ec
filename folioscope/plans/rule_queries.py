"""Rules, reviews, budgets and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import textnorm as N
from folioscope.operators import gates, metrics, review, spans
from folioscope.sources.io import as_timestamp, table
from folioscope.sources.store import scratch

from .key_queries import scribe, scribe_sql, search_sql
from .registry import GRAMS, key_sql, registry
from .text_queries import streams

QUERIES, ORACLES, query = registry()

_RULES = """
r AS (
  SELECT d.doc_id, d.source, l.quality, l.toxic, CASE WHEN l.quality IS NULL THEN 0.8 ELSE 0.5 + 0.5 * l.quality END AS start,
         coalesce(l.quality = 0, false) AS unreadable, d.n_chars < 200 AS short, coalesce(l.toxic = 1, false) AS flagged
  FROM documents d LEFT JOIN labels l USING (doc_id)
), c AS (
  SELECT *, round(least(start, CASE WHEN unreadable THEN 0.5 ELSE 1 END, CASE WHEN short THEN 0.85 ELSE 1 END, CASE WHEN flagged THEN 0.6 ELSE 1 END)::DOUBLE, 3) AS confidence,
         array_to_string(list_filter([CASE WHEN flagged THEN 'flagged' END, CASE WHEN short THEN 'short text' END, CASE WHEN unreadable THEN 'unreadable' END], lambda x: x IS NOT NULL), '; ') AS why
  FROM r
)"""


def _judged(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    start = F.when(F.col("quality").isNull(), 0.8).otherwise(0.5 + 0.5 * F.col("quality"))
    value, reasons = gates.confidence(start, [(F.col("quality") == 0, 0.5, "unreadable"), (F.col("n_chars") < 200, 0.85, "short text"), (F.col("toxic") == 1, 0.6, "flagged")])
    return rows.withColumn("confidence", value).withColumn("reasons", reasons)


@query(f"WITH {_RULES} SELECT doc_id, confidence, CASE WHEN why = '' THEN 'low confidence' ELSE why END AS reason FROM c WHERE confidence < 0.75")
def confidence_rules(spark, d):
    return gates.review_queue(_judged(spark, d)).select("doc_id", "confidence", "reason")


@query(f"""
WITH {_RULES}, q AS (SELECT doc_id, source, confidence FROM c WHERE confidence < 0.75),
res AS (SELECT source, doc_id, arg_max(quality, quality) AS note FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1, 2)
SELECT q.doc_id, q.confidence, CASE WHEN res.note IS NULL THEN 'open' ELSE 'closed' END AS state, res.note AS note FROM q LEFT JOIN res ON res.source = q.source AND res.doc_id = q.doc_id""")
def review_overlay(spark, d):
    """Documents that a reader found not toxic are resolved with the quality they gave."""
    queue = gates.review_queue(_judged(spark, d)).select("doc_id", "source", "confidence", F.col("doc_id").cast("string").alias("block"))
    given = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 0"), "doc_id")
    resolutions = given.select("source", F.col("doc_id").cast("string").alias("block"), F.lit("reader").alias("by"), F.col("quality").alias("note"), F.lit(0).alias("at"))
    out = gates.resolve(queue, resolutions, page="source")
    return out.select("doc_id", "confidence", F.when(F.col("resolution").isNull(), "open").otherwise("closed").alias("state"), F.col("resolution").alias("note"))


_LETTERS = lambda x: f"coalesce(nullif({search_sql(x)}, ''), regexp_replace({x}, '{K.DIACRITICS}', '', 'g'))"


@query(rf"""
WITH w AS (SELECT item_id, i, {scribe_sql('w[i]')} AS w FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark))),
r AS (SELECT item_id, i, w, CASE WHEN (item_id + i) % 2 = 0 THEN w || 'ً' ELSE w END AS b FROM w),
v AS (SELECT item_id, i, b, CASE (item_id + i) % 7 WHEN 2 THEN w WHEN 3 THEN w || 'ن' WHEN 4 THEN NULL WHEN 6 THEN w || 'ُ' ELSE b END AS c, CASE i % 4 WHEN 0 THEN w WHEN 1 THEN NULL WHEN 2 THEN w || 'ن' ELSE b END AS a, (item_id * 7 + i * 13) % 100 AS conf, item_id % 5 = 0 AS furniture FROM r),
k AS (SELECT *, coalesce({_LETTERS('c')} = {_LETTERS('b')}, false) AS third, furniture OR coalesce({_LETTERS('a')} = {_LETTERS('b')}, false) AS first FROM v)
SELECT item_id, i AS place, CASE WHEN NOT third THEN 'disputed' WHEN first AND c = b THEN 'agree' WHEN first AND NOT regexp_matches(c, '[ً-ْٰ]') AND regexp_matches(b, '[ً-ْٰ]') THEN 'abstain' WHEN NOT first AND c = b AND (a IS NULL OR conf < 60) THEN 'abstain_a' ELSE 'disputed' END AS status FROM k""")
def vote3(spark, d):
    """Every word of the passages as three readers have it: with marks, without, with another letter, unread."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("p", "raw")).withColumn("i", F.col("p") + 1)
    words = words.withColumn("w", scribe(F.col("raw")))
    i, w, n = F.col("i"), F.col("w"), F.lit("ن")
    b = F.when((F.col("item_id") + i) % 2 == 0, F.concat(w, F.lit("ً"))).otherwise(w)
    k = (F.col("item_id") + i) % 7
    c = F.when(k == 2, w).when(k == 3, F.concat(w, n)).when(k == 6, F.concat(w, F.lit("ُ"))).when(k != 4, b)
    a = F.when(i % 4 == 0, w).when(i % 4 == 2, F.concat(w, n)).when(i % 4 == 3, b)
    status = review.vote3(a, b, c, ((F.col("item_id") * 7 + i * 13) % 100).cast("double"), F.col("item_id") % 5 == 0, stable=True)
    return words.select("item_id", i.cast("long").alias("place"), status.alias("status"))


@query("""
WITH k AS (SELECT doc_id, lang, -ln((((doc_id + 1) * 2654435761) % 4294967296 + 1) / 4294967297.0::DOUBLE) / CASE WHEN n_chars > 2000 THEN 3 ELSE 1 END AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM k)
SELECT lang, doc_id FROM r WHERE r <= greatest(floor(n * CASE lang WHEN 'en' THEN 0.05 ELSE 0.1 END), 1)""")
def sample_strata(spark, d):
    rates = {"en": 0.05, "de": 0.1, "es": 0.1, "fr": 0.1}
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return review.sample_strata(docs, "doc_id", "lang", rates, F.when(F.col("n_chars") > 2000, 3).otherwise(1)).select("lang", "doc_id")


@query("""
WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(sum(value), 2) AS spent FROM events GROUP BY 1),
t AS (SELECT day, spent, round(sum(spent) OVER (ORDER BY day), 2) AS total FROM d)
SELECT day, spent, total, total >= 2000 AS warn, total >= 2500 AS stop FROM t""")
def daily_spend(spark, d):
    return review.daily_spend(as_timestamp(table(spark, d, "events")), F.col("value"), cap=2500.0)


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT event_id, user_id, k, [ts] AS kept, true AS allowed FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.k,
         CASE WHEN len(list_filter(f.kept, lambda x: x >= e.ts - INTERVAL 1 HOUR)) < 2 THEN list_append(list_filter(f.kept, lambda x: x >= e.ts - INTERVAL 1 HOUR), e.ts) ELSE list_filter(f.kept, lambda x: x >= e.ts - INTERVAL 1 HOUR) END,
         len(list_filter(f.kept, lambda x: x >= e.ts - INTERVAL 1 HOUR)) < 2
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1
)
SELECT event_id, user_id AS user, allowed FROM f""")
def rate_limit(spark, d):
    return review.rate_limit(table(spark, d, "events"), limit=2).select("event_id", "user", "allowed")


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def event_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query(f"""
WITH {GRAMS}, gold AS (SELECT DISTINCT p.item_id AS passage_id, d.doc_id AS text_id FROM benchmark p, documents d WHERE contains(' ' || {key_sql('d.text')} || ' ', ' ' || {key_sql('p.text')} || ' ')),
found AS (SELECT DISTINCT passage_id, text_id FROM votes WHERE votes >= 6),
b AS (SELECT coalesce(g.passage_id, f.passage_id) AS passage_id, g.text_id AS gt, f.text_id AS ft FROM gold g FULL JOIN found f ON f.passage_id = g.passage_id AND f.text_id = g.text_id),
c AS (SELECT passage_id, count(gt) AS n_gold, count(ft) AS n_found, count(CASE WHEN gt = ft THEN 1 END) AS n_both FROM b GROUP BY 1),
m AS (SELECT *, CASE WHEN n_found > 0 THEN n_both / n_found::DOUBLE ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN n_both / n_gold::DOUBLE ELSE 0 END AS r FROM c)
SELECT passage_id, n_gold, n_found, n_both, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def prf(spark, d):
    """How well trigram votes find the documents that hold a passage whole."""
    passages, texts = streams(spark, d)
    votes = scratch(spans.votes(passages, texts), "votes")
    found = votes.where("votes >= 6").select("passage_id", "text_id").distinct()
    # A document that holds a passage whole shares all its trigrams at one start, so only pairs with that many votes are read.
    key = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    sized = votes.join(passages.select(F.col("id").alias("passage_id"), key("words").alias("p"), F.size("words").alias("size")), "passage_id")
    pairs = sized.where("votes >= size - 2").select("passage_id", "text_id", "p").distinct().join(texts.select(F.col("id").alias("text_id"), key("words").alias("t")), "text_id")
    gold = pairs.where(F.contains("t", F.col("p"))).select("passage_id", "text_id")
    return metrics.prf(gold, found, ["text_id"], ["passage_id"])


def _pairs(spark, d):
    """(item_id, r, h): the keys of each passage and of the document of its number."""
    a = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("b"))
    return a.join(b, "item_id").select("item_id", N.latin_key(F.col("a")).alias("r"), N.latin_key(F.col("b")).alias("h"))


@query(f"""
WITH p AS (SELECT a.item_id, b.doc_id, {key_sql('a.text')} AS r, {key_sql('b.text')} AS h FROM benchmark a JOIN documents b ON b.doc_id = a.item_id)
SELECT item_id, round(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r)::DOUBLE WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END, 6) AS cer FROM p""")
def cer(spark, d):
    """Character error rate of each passage against the document of its number, over whole texts."""
    return _pairs(spark, d).select("item_id", F.round(metrics.cer(F.col("r"), F.col("h")), 6).alias("cer"))


@query()
def wer(spark, d):
    """Word error rate of each passage against the document of its number, over whole texts."""
    return _pairs(spark, d).select("item_id", F.round(metrics.wer(F.col("r"), F.col("h")), 6).alias("wer"))


@query("SELECT count(*) AS n, count_if(one) AS consistent, round(avg(CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT user_id, count(DISTINCT event_type) = 1 AS one FROM events GROUP BY 1)")
def consistency(spark, d):
    return metrics.consistency(table(spark, d, "events"), "user_id", "event_type")


@query("""
SELECT lang, count(*) AS n, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good_share
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def summary_report(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    good = F.coalesce((F.col("quality") == 1).cast("double"), F.lit(0.0))
    return rows.rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg(good), 6).alias("good_share"))
