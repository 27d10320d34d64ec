"""Centroid clustering of integer vectors, exact in every step.

Squared distances are expanded as |x|^2 - 2 x.c + |c|^2, so a block of vectors
meets all centroids in one matrix product of 64-bit floats (BLAS). Integers
below 2^53 are exact there: bounds of the magnitudes guard every block, and a
block beyond them is computed in 64-bit integers, or in Python's, where those
could wrap. ``RDD.treeAggregate`` adds up sums and counts, so a round moves one
small table a task and the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors of a block, and values of a stripe's distances that a task holds at once.
BLOCK, STRIPE = 4096, 1 << 20
#: Integers up to which 64-bit floats, and 64-bit integers, are exact.
FLOAT_EXACT, LONG_EXACT = 1 << 53, (1 << 63) - 1


def packed(values: np.ndarray) -> bytes:
    """A block of integers in the fewest of 2, 4 or 8 bytes each, or as decimal text where they are larger."""
    if values.dtype == object:
        return b"\0" + json.dumps([[int(x) for x in row] for row in values]).encode()
    most = max(-int(values.min(initial=0)), int(values.max(initial=0)) + 1)
    size = 2 if most <= 1 << 15 else 4 if most <= 1 << 31 else 8
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    if blob[0] == 0:
        return np.array(json.loads(blob[1:]), dtype=object).reshape(-1, dim)
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, where one doesn't fit, as Python's."""
    y = np.floor(x * float(scale))
    if not np.isfinite(y).all():  # only scale * x overflows here
        return np.array([[int(float(v)) * scale if abs(v) > 2**60 else int(np.floor(v * scale)) for v in row] for row in x], dtype=object).reshape(x.shape)
    if not y.size or np.abs(y).max() < 2**62:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], dtype=object).reshape(x.shape)


def _magnitude(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of integers; ties to the smaller number."""
    most = max(_magnitude(x), _magnitude(centroids))
    bound = 4 * x.shape[1] * most * most  # |x|^2 + 2 |x.c| + |c|^2
    if bound < FLOAT_EXACT:
        kind = np.float64
    elif bound <= LONG_EXACT and x.dtype != object and centroids.dtype != object:
        kind = np.int64
    else:
        kind = object
    c = centroids.astype(kind)
    square = (c * c).sum(axis=1)
    clusters, distances = np.empty(len(x), np.int64), np.empty(len(x), object if kind is object else np.int64)
    for i in range(0, len(x), max(1, STRIPE // len(c))):
        part = slice(i, i + max(1, STRIPE // len(c)))
        a = x[part].astype(kind)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + square
        best = np.array([min(range(len(c)), key=row.__getitem__) for row in d]) if kind is object else d.argmin(axis=1)
        clusters[part], distances[part] = best, d[np.arange(len(a)), best]
    return clusters, distances


def _sums(x: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """Sums and, last, counts by cluster: a matrix product where it is exact, else integers."""
    ones = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    most = _magnitude(ones)
    if most * len(x) < FLOAT_EXACT:
        member = np.zeros((k, len(x)))
        member[clusters, np.arange(len(x))] = 1.0
        return (member @ ones.astype(np.float64)).astype(np.int64)
    out = np.zeros((k, x.shape[1] + 1), np.int64 if x.dtype != object and most * len(x) <= LONG_EXACT else object)
    np.add.at(out, clusters, ones)
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two tables of integers, in Python's where 64 bits might not do."""
    if a.dtype != object and b.dtype != object and _magnitude(a) + _magnitude(b) <= LONG_EXACT:
        return a + b
    return a.astype(object) + b.astype(object)


def _tightened(values: list[list[int]]) -> np.ndarray:
    fits = all(abs(v) <= LONG_EXACT for row in values for v in row)
    return np.array(values, dtype=np.int64 if fits else object)


def kept_vectors(df: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the components of the vectors that have ``dim`` of them, none null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where((F.size(x) == dim) & whole).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[float]]:
    """The vectors with the k smallest hashes of their ids, in that order; equal ids by their components."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def blocks_of(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(ids, valid, body): vectors packed as integers, up to BLOCK of a partition in a row."""

    def run(batches):
        for b in batches:
            ids, x = b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(x), BLOCK):
                part = ids.slice(i, BLOCK)
                values = whole_numbers(x[i : i + BLOCK], scale)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([part.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([packed(values)], pa.binary())],
                    names=["ids", "valid", "body"],
                )

    return vectors.mapInArrow(run, "ids binary, valid binary, body binary")


def centroid_clusters(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    Vectors of another length, null ones and those with null or non-finite
    components are left out; each other row, repeated or without id, gets a row
    (null ids never start a centroid). With fewer vectors than k there are fewer
    clusters; an empty table gives no rows. All sums, means (floors) and
    distances are exact whatever the magnitude; a distance or inertia beyond a
    long's range is given as its largest value.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = kept_vectors(df, dim, id_col, vector_col)
    blocks = stored(blocks_of(vectors, dim, scale), "vector-blocks")
    start = first_centroids(vectors, k, salt)
    if not start:
        return spark.createDataFrame([], schema)
    centroids = whole_numbers(np.array(start, np.float64), scale)
    k = len(centroids)
    bodies = blocks.select("body").rdd.map(lambda r: r.body)

    def assigned(make, zero):
        held = sc.broadcast(centroids)
        out = bodies.treeAggregate(zero, lambda total, body: _added(total, make(unpacked(bytes(body), dim), held.value)), _added, depth=2)
        held.unpersist()
        return out

    for _ in range(rounds):
        total = assigned(lambda x, c: _sums(x, nearest(x, c)[0], k), np.zeros((k, dim + 1), np.int64))
        means = [[int(v) // int(row[-1]) for v in row[:-1]] if row[-1] else list(map(int, old)) for row, old in zip(total, centroids, strict=True)]
        centroids = _tightened(means)

    def spread(x, c):
        cluster, distance = nearest(x, c)
        out = np.zeros((k, 1), object)
        np.add.at(out, (cluster, 0), distance.astype(object))
        return out

    exact = [int(v[0]) for v in assigned(spread, np.zeros((k, 1), object))]
    inertia, whole = [min(v, LONG_EXACT) for v in exact], min(sum(exact), LONG_EXACT)
    names = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids]
    held = sc.broadcast((centroids, np.array(inertia, np.int64), np.array(names, object)))

    def label(batches):
        c, per, sha = held.value
        for b in batches:
            for ids, valid, body in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
                cluster, distance = nearest(unpacked(body, dim), c)
                distance = np.minimum(distance, LONG_EXACT).astype(np.int64)
                gone = ~np.frombuffer(valid, bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=gone), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(per[cluster], pa.int64()), pa.array(np.full(len(cluster), whole), pa.int64()), pa.array(sha[cluster], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(label, schema)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))
