"""Near-duplicates by MinHash.

* Signatures: many universal hash functions of a set's shingles, the minimum of
  each. Equal sets have one signature and are one leaf from here on.
* Banding: BANDS bands of ROWS minima; two sets with one equal band are in one
  bucket. A pair at Jaccard similarity j has none with probability
  (1 - j ** ROWS) ** BANDS: 7e-11 at 0.85.
* Signature verification: inside a bucket, pairs whose signatures agree in too
  few places for the threshold (less than once in 10^9 for a linked pair) go;
  what stays joins sets into families.
* Links are confirmed on the full sets, inside families only, and components are
  found by alternating large and small stars.

Buckets and families are searched by ``jaccard_join._search``: bounded ones in
one task, heavy ones in slots; no bucket is expanded into its pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, join_hot, mix64, stored, table
from .components import connected_components
from .jaccard_join import Forest, Kernel, _search, _texts, fingerprint, labelled, linked, release, shingle_set

ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
#: Sets of a bucket, and shingles of a family, that one task takes.
NODE_LEAVES, FAMILY_SHINGLES = 8192, 4_000_000
#: Leaves that are compared with all others of a task first.
STARS = 3
#: How seldom signature verification may refuse a linked pair.
REFUSED = 1e-9

_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
#: Multipliers and shifts of the hash functions: (low * a + high * b + c) mod 2^64, its upper half, is universal for 64-bit keys.
_A, _B, _C = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD + np.uint64(seed))[:, None] for seed in (0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))


def minima(s: np.ndarray) -> np.ndarray:
    """The signature of a set of 64-bit shingles: the minimum of each hash function, 32 bits each."""
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(s), 512):
        part = s[i : i + 512]
        h = _A * (part & np.uint64(0xFFFFFFFF))
        h += _B * (part >> _HALF)
        h += _C
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> _HALF).astype(np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bands = low.reshape(BANDS, ROWS).astype(np.uint64)
    acc = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)
    for k in range(ROWS):
        acc = mix64(acc * _ODD + bands[:, k])
    return acc.view(np.int64)


def least_matches(num: int, den: int) -> int:
    """Equal places below which a pair with similarity num / den or more falls with probability REFUSED at most."""
    j, total, m = num / den, 0.0, 0
    while m < HASHES and total + comb(HASHES, m) * j**m * (1 - j) ** (HASHES - m) <= REFUSED:
        total += comb(HASHES, m) * j**m * (1 - j) ** (HASHES - m)
        m += 1
    return m


def agreeing(a: np.ndarray, b: np.ndarray, least: int):
    """Arrays of pairs (row of a, row of b, equal places) with at least that many, in blocks."""
    for i in range(0, len(a), 32):
        for k in range(0, len(b), 2048):
            same = (a[i : i + 32, None, :] == b[None, k : k + 2048, :]).sum(axis=2, dtype=np.int16)
            x, y = np.nonzero(same >= least)
            if len(x):
                yield x + i, y + k, same[x, y].astype(np.int64)


class SignatureKernel(Kernel):
    """Leaves carry their signature, a byte a place, and in the exact search their text after it."""

    def __init__(self, possible: bool, words: int, num: int, den: int):
        super().__init__(possible, words, num, den)
        self.least = least_matches(num, den)

    def _read(self, t: pa.Table):
        bodies = t.column("body").to_pylist()
        signatures = np.frombuffer(b"".join(b[:HASHES] for b in bodies), np.uint8).reshape(-1, HASHES)
        sets: dict[int, np.ndarray] = {}

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(bodies[k][HASHES:].decode(), self.words)
            return sets[k]

        return signatures, set_of

    def inside(self, t: pa.Table):
        for run in self._leaves(t):
            n = run.num_rows
            if n < 2:
                continue
            s, set_of = self._read(run)
            forest = Forest(n, (lambda p, q: True) if self.possible else (lambda p, q, of=set_of: linked(of(p), of(q), self.num, self.den)))
            out = np.arange(n)
            for _ in range(STARS if n > 16 else 0):
                some = out[:: max(1, len(out) // 64)]
                centre = int(some[(s[some, None, :] == s[None, some, :]).sum(axis=(1, 2)).argmax()])
                for _, y, over in agreeing(s[centre : centre + 1], s, self.least):
                    forest.join(np.full(len(y), centre), y, over)
                root = forest.roots()
                out = np.flatnonzero(root != np.bincount(root).argmax())
                if not len(out):
                    break
            place = np.full(n, -1)
            place[out] = np.arange(len(out))
            for x, y, over in agreeing(s[out], s, self.least):
                once = (place[y] < 0) | (place[y] > x)
                forest.join(out[x[once]], y[once], over[once])
            marks = run.column("mark").to_pylist()
            for p, q in forest.links:
                yield marks[p], marks[q]

    def across(self, t: pa.Table):
        side = t.column("side").to_numpy()
        a, b = (t.filter(pa.array(side == k)) for k in (0, 1))
        if not a.num_rows or not b.num_rows:
            return
        (sa, of_a), (sb, of_b) = self._read(a), self._read(b)
        na = a.num_rows
        # Leaves of one component start joined, so a link is looked for once for each two components.
        _, group = np.unique(a.column("component").to_pylist() + b.column("component").to_pylist(), return_inverse=True)
        forest = Forest(len(group), (lambda p, q: True) if self.possible else (lambda p, q: linked(of_a(p), of_b(q - na), self.num, self.den)))
        first = np.full(group.max() + 1, len(group))
        np.minimum.at(first, group, np.arange(len(group)))
        forest.parent = first[group]
        for x, y, over in agreeing(sa, sb, self.least):
            forest.join(x, y + na, over)
        ma, mb = a.column("mark").to_pylist(), b.column("mark").to_pylist()
        for p, q in forest.links:
            yield ma[p], mb[q - na]


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, mark of every row; short (64 bits of the mark), sig and keys where a task meets a set first."""
    schema = "doc_id long, tag long, n_shingles long, mark binary, short long, sig binary, keys array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        seen = set()
        for b in batches:
            out = [[] for _ in names]
            for d, t, tag in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingle_set(t, words)
                mark = fingerprint(s) if len(s) else None
                fresh = mark is not None and mark not in seen
                short = sig = keys = None
                if fresh:
                    seen.add(mark)
                    low = minima(s)
                    short, sig, keys = int.from_bytes(mark[8:16], "little", signed=True), low.astype(np.uint8).tobytes(), band_keys(low)
                for column, value in zip(out, (d, tag, len(s), mark, short, sig, keys), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        seen.clear()
        give_back()

    return docs.mapInArrow(run, schema)


def bucket_members(signed: DataFrame) -> DataFrame:
    """(gid, short) of the buckets with at least two sets; buckets with equal members are one."""
    keyed = signed.where("keys is not null").select("short", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("short").alias("low"), F.max("short").alias("high"), F.count("*").alias("rows")).where("low != high").select("key", "rows")
    members = stored(join_hot(keyed, stored(buckets, "buckets"), "key", "rows").select("key", "short").distinct(), "bucket-members")
    names = members.groupBy("key").agg(F.xxhash64(F.bit_xor(F.xxhash64("short")), F.bit_xor(F.xxhash64("short", F.lit(1))), F.count("*")).alias("gid"), F.count("*").alias("rows"))
    once = stored(names.groupBy("gid", "rows").agg(F.min("key").alias("key")), "bucket-names")
    return join_hot(members, once, "key", "rows").select("gid", "short")


def minhash_components(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df``.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of
    word shingles; every link is confirmed on the full sets. component_id is the
    smallest id reachable by links, and the row with that id is kept. Null texts
    and texts without words link with nothing and are kept. Rows without id take
    part in linking; a component of such rows alone has a null component_id and
    keeps all its rows, as no id tells them apart. Repeated rows give repeated
    rows (each keeps or goes by its id), other columns are left out, and an empty
    table gives no rows. Bands can miss a link, at 0.85 one of 10^10.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("long").alias("tag"))
    signed = stored(_signed(docs.select("doc_id", "text", "tag"), words), "signatures")
    nodes = stored(bucket_members(signed), "buckets")
    release(spark)
    score = nodes.groupBy("short").agg(F.count("*").alias("score"))
    sets = signed.where("sig is not null").select("short", "mark", F.col("n_shingles").alias("n"), F.col("sig").alias("body")).join(score, "short").dropDuplicates(["mark"])
    classes = stored(sets, "classes")
    members = stored(nodes.join(classes, "short").select("gid", "mark", "n", "body", "score").withColumn("one", F.lit(1)), "members")
    maybe = _search(members, "one", NODE_LEAVES, SignatureKernel(True, words, num, den))
    discard(members)
    discard(nodes)
    families = connected_components(maybe)
    wanted = stored(families.withColumnsRenamed({"node": "mark", "component": "family"}).join(classes.select("mark", "n", "body"), "mark"), "families")
    degree = maybe.select(F.explode(F.array("a", "b")).alias("mark")).groupBy("mark").agg(F.count("*").alias("score"))
    body = F.concat(F.col("w.body"), F.encode(F.col("t.body"), "UTF-8"))
    rows = wanted.alias("w").join(degree.alias("d"), "mark").join(_texts(docs, wanted, words).alias("t"), "mark").select(F.xxhash64("family").alias("gid"), "mark", "n", body.alias("body"), "score")
    rows = stored(rows, "family-leaves")
    release(spark)
    links = _search(rows, "n", FAMILY_SHINGLES, SignatureKernel(False, words, num, den))
    discard(rows)
    found = connected_components(links)
    for done in (classes, maybe, wanted, links):
        discard(done)
    out = labelled(signed, found.withColumnRenamed("node", "mark"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
