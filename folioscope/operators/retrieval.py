"""Lexical, dense and phrase retrieval, rank fusion and assembly of passages.

The lexical searches stand on an inverted index (``postings``); ``bm25`` is the
same score as plain joins, for small sets of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.constants import LIMITS
from folioscope.sources.io import read_version, write_version
from folioscope.sources.store import scratch

from .postings import Index, lexical_rows, lexical_top, phrase_top, standing, write_index  # noqa: F401  the searches' one front
from .ranking import best, expand_terms, half_up, ranked

#: Questions that are scored together, and vectors.
QUERY_BLOCK, VECTOR_BLOCK = 256, 8192


def bm25(texts: DataFrame, queries: DataFrame, k1: float = LIMITS.bm25_k1, b: float = LIMITS.bm25_b, prefix: bool = False) -> DataFrame:
    """(qid, id, score) for texts (id, words) and query terms (qid, qterm).

    Only the queries' terms are counted: texts are cut down to them before the
    shuffle. A prefix term is one term that adds up its matches.
    """
    size = texts.select("id", F.size("words").alias("dl"))
    stats = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    queries = queries.distinct()
    if prefix:
        terms = expand_terms(queries, texts.select(F.explode("words").alias("term")).distinct())
    else:
        terms = queries.withColumn("term", F.col("qterm"))
    wanted = texts.select("id", F.explode("words").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.count("*").alias("tf"))
    hits = wanted.join(terms, "term").groupBy("qid", "qterm", "id").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("qid", "qterm").agg(F.count("*").alias("df"))
    rows = hits.join(df, ["qid", "qterm"]).join(size, "id").join(F.broadcast(stats))  # stats is one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(raw > 0, raw).otherwise(F.lit(1e-6))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its length."""
    d = v.cast("array<double>")
    length = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(d, lambda x: x / length)).otherwise(d)


def merged(found: DataFrame, n: int) -> DataFrame:
    """The n best of each question from the bests of all blocks."""
    return ranked(found.groupBy("qid", "id").agg(F.max("score").alias("score")), n)


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, ids, body): vectors (id, vec) of one length as bytes, up to ``size`` of a partition in a row."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            lengths, ids = np.diff(lists.offsets.to_numpy()), b.column(0).to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                for i in range(0, len(rows), size):
                    some = rows[i : i + size]
                    body = flat[(ends[some] - d)[:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)]), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([body.astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "body"])

    return vectors.mapInArrow(run, "dim long, ids binary, body binary")


def dense_top(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(qid, id, score, rank): the n best other ids of each question by inner product.

    Questions (qid, qvec) and vectors (id, vec) are packed into blocks; each pair
    of blocks of one vector length is one row and gives its n best of each
    question. Rows without id or vector are neither asked nor hit, vectors of
    another length than the question's aren't compared, and of a repeated id the best counts.
    """
    double = "array<double>"
    asked = queries.where("qid is not null and qvec is not null").select(F.col("qid").cast("long").alias("id"), F.col("qvec").cast(double).alias("vec")).distinct()
    rows = vectors.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast(double).alias("vec"))
    ones = scratch(_packed(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))), QUERY_BLOCK).withColumn("q", F.monotonically_increasing_id()), "question-blocks")
    twos = scratch(_packed(rows, VECTOR_BLOCK).withColumn("v", F.monotonically_increasing_id()), "vector-blocks")

    def run(batches):
        for b in batches:
            for dim, qi, qb, vi, vb in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                qids, ids = np.frombuffer(qi, "<i8"), np.frombuffer(vi, "<i8")
                scores = half_up(np.frombuffer(vb, "<f8").reshape(len(ids), dim) @ np.frombuffer(qb, "<f8").reshape(len(qids), dim).T)
                scores[ids[:, None] == qids[None, :]] = -np.inf
                found = [best(scores[:, k], ids, n) for k in range(len(qids))]
                at, column = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(qids)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(qids[column]), pa.array(ids[at]), pa.array(scores[at, column])], names=["qid", "id", "score"])

    # Numbers of blocks meet first; the blocks are joined to them by number, the vectors' last.
    pairs = ones.select("q", "dim").join(twos.select("v", "dim"), "dim").select("q", "v")
    met = pairs.join(ones.select("q", F.col("ids").alias("qids"), F.col("body").alias("qbody"), "dim"), "q").join(twos.drop("dim"), "v")
    return merged(met.select("dim", "qids", "qbody", "ids", "body").mapInArrow(run, "qid long, id long, score double"), n)


def fuse(lists: list[tuple[str, DataFrame]], k: int = LIMITS.rrf_k, n: int = LIMITS.result_k) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, id, rank), in order of priority.

    score = sum of 1 / (k + rank); ties go to the list of highest priority and
    the better rank there, then to the smaller id.
    """
    rows = [df.select("qid", "id", "rank", F.lit(i).alias("priority"), F.lit(name).alias("list")) for i, (name, df) in enumerate(lists)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    ranks = [F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name, _ in lists]
    scores = every.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("priority", "rank")).alias("first"), *ranks)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("first")


def with_similarity(hits: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds dense_available and dense_sim to hits (qid, id): the best inner product over a unit's vectors
    (id, vec) with the question's (qid, qvec); null where either has none. Only the hits' vectors meet."""
    pairs = hits.select("qid", "id").join(asked, "qid").join(vectors, "id").groupBy("qid", "id").agg(F.max(F.round(dot(F.col("vec"), F.col("qvec")), 6)).alias("dense_sim"))
    have = asked.select("qid", F.lit(True).alias("_have")).distinct()
    return hits.join(pairs, ["qid", "id"], "left").join(have, "qid", "left").withColumn("dense_available", F.coalesce("_have", F.lit(False))).drop("_have")


def search(units: dict[str, Index], mode: str, terms: DataFrame, n: int = LIMITS.result_k, windows: dict[str, int] | None = None) -> DataFrame:
    """The lexical search over the index that a mode names; ``windows`` has how many rows a unit of a mode may have."""
    if mode not in units:
        raise ValueError(f"unknown mode: {mode}")
    return lexical_top(units[mode], terms, n, windows=(windows or {}).get(mode, 1)).withColumn("mode", F.lit(mode))


def embedded(texts: DataFrame, embed, cache: str, size: int = 64) -> DataFrame:
    """(id, vec) of texts (id, text) by ``embed``, a function of a list of texts, in batches of ``size``.

    ``cache`` is a versioned table of vectors by the texts' hashes. Texts that it
    holds are never asked for again, by any run, and of new ones each distinct
    text is asked for once, by one task; the next version then has them too. A run
    that fails leaves the last version. Null texts have no vector.
    """
    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hashed = rows.withColumn("hash", F.sha2(F.encode("text", "UTF-8"), 256))
    known = read_version(texts.sparkSession, cache, "hash string, vec array<double>")
    new = hashed.where("hash is not null").groupBy("hash").agg(F.first("text").alias("text")).join(known, "hash", "left_anti").select("hash", "text")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, size):
                some = b.slice(i, size)
                vectors = [[float(x) for x in v] for v in embed(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["hash", "vec"])

    found = scratch(new.mapInArrow(run, "hash string, vec array<double>"), "embedded")
    if not found.isEmpty():
        write_version(known.unionByName(found), cache)
        known = read_version(texts.sparkSession, cache, "hash string, vec array<double>")
    return hashed.join(known, "hash", "left").select("id", "vec")


def assemble(hits: DataFrame, units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits with their unit's blocks in order: units (id, block_ids), blocks (block_id, text)."""
    ids = units.select("id", F.posexplode("block_ids").alias("pos", "block_id")).join(blocks, "block_id")
    parts = ids.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("parts"))
    return hits.join(parts, "id", "left")
