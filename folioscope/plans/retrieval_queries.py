"""Retrieval and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import gates, metrics, retrieval
from folioscope.sources.io import table
from folioscope.sources.store import scratch

from .registry import key_sql, registry, words_sql

QUERIES, ORACLES, query = registry()

#: A vector search asks with the vectors whose id is divisible by this.
EVERY = 100


def questions(spark, d):
    """Questions that quote their words 3 to 6, if they have six."""
    text = N.latin_key(F.col("text"))
    w = T.words(text)
    quoted = F.concat_ws(" ", F.array_join(F.slice(w, 1, 2), " "), F.concat(F.lit("«"), F.array_join(F.slice(w, 3, 4), " "), F.lit("»")), F.array_join(F.slice(w, F.lit(7), F.size(w)), " "))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), text.alias("key"), F.when(F.size(w) >= 6, quoted).otherwise(text).alias("question"))


def texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), N.latin_key(F.col("text")).alias("key")).withColumn("words", T.words(F.col("key")))


def index(spark, d):
    """The standing index of all documents."""
    return retrieval.standing(spark, f"documents of {d}", lambda: texts(spark, d).select("id", "key"))


def question_terms(spark, d):
    return questions(spark, d).select("qid", F.explode(T.query_terms(F.col("key"))).alias("qterm"))


def lexical(spark, d, n):
    return retrieval.lexical_top(index(spark, d), question_terms(spark, d), n)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense_list(spark, d, n, asked=None):
    """A question asks with the vector of its number: those of ``asked`` (qid), else every hundredth vector."""
    v = vectors(spark, d)
    q = v.withColumnRenamed("id", "qid").withColumnRenamed("vec", "qvec")
    q = q.where(F.col("qid") % EVERY == 0) if asked is None else q.join(asked.select("qid").distinct(), "qid", "left_semi")
    return retrieval.dense_top(q, v, n)


def phrases(spark, d):
    return questions(spark, d).select("qid", F.explode(T.quoted_phrases(F.col("question"))).alias("phrase"))


_ASKED = f"""
q AS (SELECT item_id AS qid, {words_sql()} AS w FROM benchmark),
terms AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(w) AS term FROM q) WHERE length(term) >= 2)"""


def bm25_sql(rows: str, x: str = "") -> str:
    """bm{x} (qid, id, score): the score of each of ``rows`` (id, words); terms of four letters match what they begin."""
    return f"""
d{x} AS (SELECT row_number() OVER () AS rid, id, words FROM ({rows})),
st{x} AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM d{x}),
dt{x} AS (SELECT rid, term, count(*) AS n FROM (SELECT rid, unnest(words) AS term FROM d{x}) GROUP BY 1, 2),
met{x} AS (SELECT q.term, w.term AS word FROM (SELECT DISTINCT term FROM terms) q JOIN (SELECT DISTINCT term FROM dt{x}) w ON w.term = q.term OR (length(q.term) >= 4 AND starts_with(w.term, q.term))),
tf{x} AS (SELECT m.term, rid, sum(n) AS tf FROM met{x} m JOIN dt{x} t ON t.term = m.word GROUP BY 1, 2),
df{x} AS (SELECT term, count(*) AS df FROM tf{x} GROUP BY 1),
bm{x} AS (
  SELECT qid, d.id, d.rid, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.words) / avgdl))), 6) AS score
  FROM terms JOIN tf{x} t USING (term) JOIN df{x} USING (term) JOIN d{x} d ON d.rid = t.rid, st{x} GROUP BY 1, 2, 3
)"""


BM25 = f"{_ASKED}, {bm25_sql(f'SELECT doc_id AS id, {words_sql()} AS words FROM documents')}"


def _dense_sql(asked: str) -> str:
    return f"""
dn AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE {asked} AND q.vec_id <> v.vec_id
)"""


_DENSE = _dense_sql(f"q.vec_id % {EVERY} = 0")
_OWN = _dense_sql("q.vec_id IN (SELECT item_id FROM benchmark)")
_PHRASE = f"""
ph AS (SELECT qid, array_to_string(w[3:6], ' ') AS phrase FROM q WHERE len(w) >= 6),
pk AS (SELECT doc_id AS id, ' ' || array_to_string(list_filter({words_sql()}, lambda w: NOT regexp_full_match(w, '[0-9]+')), ' ') || ' ' AS key FROM documents),
hit AS (SELECT qid, id FROM ph, pk WHERE contains(key, ' ' || phrase || ' ')),
pr AS (SELECT qid, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY id) AS BIGINT) AS rank FROM hit) WHERE rank <= 10)"""


def top_sql(table_name: str, n: int) -> str:
    return f"SELECT qid, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS BIGINT) AS rank FROM {table_name}) WHERE rank <= {n}"


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BM25} {top_sql('bm', 5)}")
def bm25_topk(spark, d):
    return _long(lexical(spark, d, 5)).select("qid", "id", "score", "rank")


@query(f"WITH {_DENSE} {top_sql('dn', 5)}")
def dense_topk(spark, d):
    return _long(dense_list(spark, d, 5)).select("qid", "id", "score", "rank")


@query(f"WITH {BM25}, {_PHRASE} SELECT qid, id, rank FROM pr")
def phrase_hits(spark, d):
    return _long(retrieval.phrase_top(index(spark, d), phrases(spark, d))).select("qid", "id", "rank")


_RRF = f"""
every AS (
  SELECT qid, id, rank, 0 AS priority FROM pr
  UNION ALL SELECT qid, id, rank, 1 FROM ({top_sql('bm', 30)})
  UNION ALL SELECT qid, id, rank, 2 FROM ({top_sql('dn', 30)})
), f AS (
  SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(priority * 1000 + rank) AS first,
         max(CASE WHEN priority = 0 THEN rank END) AS phrase_rank, max(CASE WHEN priority = 1 THEN rank END) AS bm25_rank, max(CASE WHEN priority = 2 THEN rank END) AS dense_rank
  FROM every GROUP BY 1, 2
), fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS BIGINT) AS rank FROM f) WHERE rank <= 5)"""


def _fused(spark, d):
    lists = [("phrase", retrieval.phrase_top(index(spark, d), phrases(spark, d))), ("bm25", lexical(spark, d, 30)), ("dense", dense_list(spark, d, 30, questions(spark, d)))]
    out = retrieval.fuse(lists)
    return out.withColumns({c: F.col(c).cast("long") for c in ("rank", "phrase_rank", "bm25_rank", "dense_rank")})


@query(f"WITH {BM25}, {_PHRASE}, {_OWN}, {_RRF} SELECT qid, id, score, phrase_rank, bm25_rank, dense_rank, rank FROM fused")
def hybrid_rrf(spark, d):
    """Flagship: phrase, lexical and dense lists fused by reciprocal ranks."""
    return _fused(spark, d).select("qid", "id", "score", "phrase_rank", "bm25_rank", "dense_rank", "rank")


@query(f"""
WITH {BM25}, {_PHRASE}, {_OWN}, {_RRF}
SELECT f.qid, f.rank, f.id, d.source, d.lang, l.quality, v.label, CASE WHEN d.doc_id IS NOT NULL THEN len({words_sql('d.text')}) END AS n_words
FROM fused f LEFT JOIN documents d ON d.doc_id = f.id LEFT JOIN labels l ON l.doc_id = f.id LEFT JOIN embeddings v ON v.vec_id = f.id""")
def assemble(spark, d):
    hits = scratch(_fused(spark, d).select("qid", "rank", "id"), "fused")
    # Only the hits' texts get a key: few hits go to the texts, not the texts to them.
    found = table(spark, d, "documents").withColumnRenamed("doc_id", "id").join(hits.select("id").distinct(), "id", "left_semi")
    docs = found.select("id", "source", "lang", F.size(T.words(N.latin_key(F.col("text")))).cast("long").alias("n_words"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return hits.join(docs, "id", "left").join(labels, "id", "left").join(vectors, "id", "left").select("qid", "rank", "id", "source", "lang", "quality", "label", "n_words")


@query(f"""
WITH {_DENSE}, q AS (SELECT DISTINCT qid FROM dn), top AS ({top_sql('dn', 5)}),
b AS (SELECT q.qid, max(score) AS best, count(score) AS n FROM q LEFT JOIN top USING (qid) GROUP BY 1)
SELECT b.qid, best, CASE WHEN n = 0 OR best < 0.55 THEN 'abstain' ELSE 'supported' END AS support,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'referral' WHEN n = 0 OR best < 0.55 THEN 'abstained' ELSE 'answered' END AS status
FROM b LEFT JOIN labels l ON l.doc_id = b.qid""")
def support_gate(spark, d):
    best = dense_list(spark, d, 5).groupBy("qid").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), "toxic")
    rows = best.join(labels, "qid", "left")
    support = gates.support(F.col("best"), F.lit(True), F.col("n"), F.lit(0))
    refer = gates.referral(F.when(F.coalesce("toxic", F.lit(0)) == 1, "D").otherwise("A"), F.lit(False))
    return rows.select("qid", "best", support.alias("support"), gates.status({"referral": refer, "abstained": support == "abstain"}).alias("status"))


_QUOTES = f"""
qt AS (
  SELECT item_id AS qid, 'doc' || (item_id % 7) AS tag, array_to_string(w[1:6], ' ') AS key FROM (SELECT item_id, {words_sql()} AS w FROM benchmark)
  UNION ALL SELECT item_id, 'doc' || item_id, array_to_string(w[2:5], ' ') FROM (SELECT item_id, {words_sql()} AS w FROM benchmark)
  UNION ALL SELECT item_id, 'doc' || item_id, array_to_string(w[1:1], ' ') FROM (SELECT item_id, {words_sql()} AS w FROM benchmark)
), ps AS (SELECT 'doc' || item_id AS tag, {key_sql()} AS hay FROM benchmark WHERE item_id % 5 <> 3),
ck AS (SELECT qid, CASE WHEN hay IS NULL THEN 'unknown tag' WHEN len(string_split(key, ' ')) < 2 THEN 'too short'
       WHEN NOT contains(' ' || hay || ' ', ' ' || key || ' ') THEN 'not in passage' END AS reason FROM qt LEFT JOIN ps USING (tag))"""


@query(f"""
WITH {_QUOTES}
SELECT qid, count(*) FILTER (WHERE reason IS NULL) AS n_kept, count(reason) AS n_removed,
       count(*) FILTER (WHERE reason IS NULL) = 0 OR count(reason) * 2 > count(*) AS withdrawn FROM ck GROUP BY 1""")
def quote_gate(spark, d):
    """Three quotes a question: from another item's passage, from its own, and of one word."""
    b = table(spark, d, "benchmark").select("item_id", N.latin_key(F.col("text")).alias("hay")).withColumn("w", T.words(F.col("hay")))
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    own = F.concat(F.lit("doc"), F.col("item_id").cast("string"))
    other = F.concat(F.lit("doc"), (F.col("item_id") % 7).cast("string"))
    quotes = b.select(F.col("item_id").alias("qid"), F.explode(F.array(F.struct(other.alias("tag"), cut(1, 6).alias("key")), F.struct(own.alias("tag"), cut(2, 4).alias("key")), F.struct(own.alias("tag"), cut(1, 1).alias("key")))).alias("q")).select("qid", "q.tag", "q.key")
    passages = b.where("item_id % 5 <> 3").select(own.alias("tag"), "hay", F.lit("").alias("note"))
    return gates.withdraw(gates.verify_quotes(quotes, passages))


@query(f"""
WITH {_DENSE}, r AS ({top_sql('dn', 30)}), gold AS (SELECT q.vec_id AS qid, v.vec_id AS id FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
f AS (SELECT qid, min(rank) AS first FROM r JOIN gold USING (qid, id) GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN coalesce(first, 99) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr
FROM (SELECT DISTINCT qid FROM gold) LEFT JOIN f USING (qid)""")
def ir_metrics(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    label = v.where("label is not null").groupBy("label").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    asked = v.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "label")
    found = dense_list(spark, d, 30)
    # Of a question's gold ids, the hits and any one other are all that the metrics need.
    one = asked.join(label, "label").select("qid", F.when(F.col("low") != F.col("qid"), F.col("low")).otherwise(F.col("high")).alias("id")).where("qid <> id")
    hits = found.select("qid", "id").join(asked, "qid").join(v, ["id", "label"]).select("qid", "id")
    return metrics.retrieval_metrics(found, one.unionByName(hits).distinct())
