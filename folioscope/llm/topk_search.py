"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

A vector is cut into equal segments; each is kept as its mean and its deviation
(the length of what the mean leaves over). By Cauchy-Schwarz, for each segment
of n components,

    distance^2 >= n (mean_q - mean_x)^2 + (dev_q - dev_x)^2,

and with |q|^2 and |x|^2 a lower bound of the distance is an upper bound of the
inner product. Bounds are taken from coarse to fine; exact integer products are
computed for the survivors only. Queries and candidates meet in blocks: a pair
of blocks is one row with two packed arrays, so a task's memory does not depend
on the size of the table, and each pair of blocks returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: Segments at each resolution.
RESOLUTIONS = (4, 16)
#: Queries whose bounds are held at once.
STRIPE = 64
SCHEMA = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(n) * mean and deviation of each segment; inner products of two
    such rows bound the inner product of the vectors from above."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    edges = np.unique(edges)
    n = np.diff(np.append(edges, x.shape[1])).astype(np.float64)
    total, square = np.add.reduceat(x, edges, axis=1), np.add.reduceat(x * x, edges, axis=1)
    return np.concatenate([total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))], axis=1)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best of these vectors, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    exact_floats = vectors.size and queries.size and float(np.abs(vectors).max()) * float(np.abs(queries).max()) * vectors.shape[1] < 2**53
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    levels = [(segment_statistics(q, s), segment_statistics(x, s)) for s in RESOLUTIONS if s < x.shape[1]] if exact_floats else []
    out = []
    for i in range(0, len(q), STRIPE):
        part = slice(i, i + STRIPE)
        bounds = levels[0][0][part] @ levels[0][1].T if levels else None
        for row, query in enumerate(range(i, min(i + STRIPE, len(q)))):
            near = np.flatnonzero(ids != query_ids[query])
            if not len(near):
                continue
            if levels and len(near) > 4 * k:
                bound = bounds[row, near]
                head = near[np.argpartition(-bound, 4 * k)[: 4 * k]]
                least = np.partition(x[head] @ q[query], len(head) - k)[len(head) - k]
                slack = 1e-9 * (1 + np.abs(bound).max())
                near = near[bound >= least - slack]
                for left, right in levels[1:]:
                    near = near[right[near] @ left[query] >= least - slack]
            score = (x[near] @ q[query]).astype(np.int64) if exact_floats else vectors[near] @ queries[query]
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), query_ids[query]), ids[near][best], score[best]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))


def narrow(x: np.ndarray) -> bytes:
    """Integers in the fewest of two, four or eight bytes each, after a byte that tells how many."""
    most = max(-int(x.min(initial=0)), int(x.max(initial=0)) + 1)
    size = 2 if most <= 1 << 15 else 4 if most <= 1 << 31 else 8
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def wide(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """One row for each block of a partition: dimension, ids and components as bytes."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                for i in range(0, len(rows), size):
                    some = rows[i : i + size]
                    x = flat[(ends[some] - d)[:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), pa.array([narrow(x)], pa.binary())], names=["dim", f"{name}_ids", f"{name}_values"])

    return vectors.mapInArrow(run, f"dim int, {name}_ids binary, {name}_values binary")


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and floor(scale * x) of every component; rows without id, null vectors, empty
    vectors and vectors with null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(x) > 0) & whole)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products (fewer, if
    there are fewer), ties to smaller ids; vectors of other dimensions are not compared.

    ``vectors`` has vec_id and v (integers). Candidates are all rows whose id is
    not the query's; a query id that is repeated with the same vector counts
    once; repeated candidates count as often as they come; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    queries = vectors.where(is_query).distinct()
    n = vectors.count()
    blocks = max(1, -(-n // CANDIDATE_BLOCK))
    # Dealt round robin, so that neither ids nor equal vectors make a block large.
    candidates = stored(_packed(vectors.repartition(blocks), CANDIDATE_BLOCK, "x").withColumn("c", F.monotonically_increasing_id()), "candidates")
    asked = stored(_packed(queries.repartition(max(1, -(-queries.count() // QUERY_BLOCK))), QUERY_BLOCK, "q").withColumn("q", F.monotonically_increasing_id()), "queries")

    def run(batches):
        for b in batches:
            for dim, qi, qv, xi, xv in zip(*(b.column(c) for c in range(5)), strict=True):
                d = dim.as_py()
                found = search_block(np.frombuffer(qi.as_py(), "<i8"), wide(qv.as_py(), d), np.frombuffer(xi.as_py(), "<i8"), wide(xv.as_py(), d), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    # Pairs of block numbers first; the blocks join them by number, the candidates' last:
    # there are many of those, so the work is dealt over as many tasks.
    pairs = asked.select("q", "dim").join(candidates.select("c", "dim"), "dim").select("q", "c")
    met = pairs.join(asked, "q").join(candidates.drop("dim"), "c")
    best = met.select("dim", "q_ids", "q_values", "x_ids", "x_values").mapInArrow(run, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)

