"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from folioscope.llm import clustering as K

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, v string, ids string"
TOP = 2**63 - 1


def brute(rows, k, rounds, dim, scale=256):
    """Sorted result rows, with Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, g in groups.items():
            centroids[n] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), n, min(d, TOP), min(per[n], TOP), min(sum(per.values()), TOP), names[n]) for i, n, d in found)


def check(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = K.centroid_clusters(df, k, rounds, dim).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute(rows, k, rounds, dim)
    return got


@pytest.mark.parametrize("size", [1.0, 1e6, 1e9, 1e15, 1e40])
def test_all_magnitudes(spark, size):
    """The float path, 64-bit integers and Python's integers give the same as plain integers."""
    rng = random.Random(int(math.log10(size)))
    rows = [(n, [rng.uniform(-size, size) for _ in range(4)]) for n in range(120)]
    check(spark, rows, 7, 3, 4)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(n % 40 if n % 9 else None, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(3)]) for n in range(90)]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0, 3.0, 4.0]), (206, [])]
    got = check(spark, rows, 12, 5, 3)
    assert len(got) == 90


def test_few_vectors_and_none(spark):
    check(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2])], 40, 2, 2)
    check(spark, [], 40, 2, 2)


def test_mixed_magnitudes_in_one_block():
    x = np.array([[2**40, 1], [5, -7], [-(2**40), 3]], np.int64)
    c = np.array([[0, 0], [2**40, 0]], np.int64)
    clusters, distances = K.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)), n) for n, s in enumerate(c)) for r in x]
    assert list(zip(map(int, distances), map(int, clusters), strict=True)) == want


def test_packing_is_lossless():
    for values in ([[1, -2], [3, 4]], [[40000, 1]], [[2**31, -(2**62)]], [[2**70, -5], [0, 1]]):
        x = np.array(values, dtype=object if max(map(max, values)) > 2**63 else np.int64)
        assert (K.unpacked(K.packed(x), 2) == x).all()
