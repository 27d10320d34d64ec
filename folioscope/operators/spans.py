"""Matching texts with known passages: n-gram votes, windows, runs, verification."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.constants import LIMITS
from folioscope.functions.tokens import words


def word_stream(df: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(id, words): the words of a normalised key."""
    return df.select(F.col(id_col).alias("id"), words(F.col(key_col)).alias("words"))


def ngrams(stream: DataFrame, n: int) -> DataFrame:
    """(id, pos, gram) for every run of n words; computed from the row's own array, no shuffle."""
    last = F.size("words") - n
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(F.col("words"), i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return stream.select("id", F.posexplode(grams).alias("pos", "gram"))


#: Rows of known values up to which they are compared where the texts are read.
KNOWN_ROWS = 200_000


def meeting(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """The rows whose value of ``on`` is known. Few known values, by a count, go to the rows
    (they are broadcast); more of them meet the rows by a shuffle."""
    known = known.select(on).distinct()
    few = known.limit(KNOWN_ROWS + 1).count() <= KNOWN_ROWS
    return rows.join(F.broadcast(known) if few else known, on, "left_semi")


def votes(passages: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """(passage_id, text_id, start, votes): equal n-grams vote for text position - passage position."""
    p = ngrams(passages, n).select(F.col("id").alias("passage_id"), F.col("pos").alias("ppos"), "gram")
    t = meeting(ngrams(texts, n).select(F.col("id").alias("text_id"), F.col("pos").alias("tpos"), "gram"), p, "gram")
    hits = p.join(t, "gram").select("passage_id", "text_id", (F.col("tpos") - F.col("ppos")).alias("start"))
    return hits.groupBy("passage_id", "text_id", "start").agg(F.count("*").alias("votes"))


def best_starts(vote_rows: DataFrame, most: int = 20) -> DataFrame:
    """Each passage's starts with the most votes; ties to the smaller text and start."""
    w = Window.partitionBy("passage_id").orderBy(F.desc("votes"), "text_id", "start")
    return vote_rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


#: Pairs whose distances are counted together, and characters of a printed text up to which they are.
PAIRS, PAIR_CHARS = 1024, 512


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def long_distances(a: str, b: str) -> list[int]:
    """The edit distances of ``a`` and every beginning of ``b``, the empty one first: a column of the
    table of distances is two long integers of its steps up and down (Myers)."""
    now, out = len(a), [len(a)]
    if not a:
        return list(range(len(b) + 1))
    have: dict[str, int] = {}
    for i, c in enumerate(a):
        have[c] = have.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, len(a) - 1
    up, down = every, 0
    for c in b:
        eq = have.get(c, 0)
        v, h = eq | down, (((eq & up) + up) ^ up) | eq
        rise, fall = down | (every & ~(h | up)), up & h
        now += (rise >> top & 1) - (fall >> top & 1)
        out.append(now)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | (every & ~(v | rise)), rise & v
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """As ``long_distances``, for pairs of texts together: row i has the distances of a[i] and the
    beginnings of b[i]; what lies beyond b[i]'s end means nothing."""
    x, y = [_codes(s) for s in a], [_codes(s) for s in b]
    m, n = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    words, steps, k = max(1, -(-int(m.max()) // 64)), int(n.max()), len(a)
    names, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    own, place = np.repeat(np.arange(k), m), np.concatenate([np.arange(len(s)) for s in x])
    have = np.zeros((words, len(names), k), np.uint64)
    one = np.uint64(1)
    np.bitwise_or.at(have, (place >> 6, code[: len(own)], own), one << (place & 63).astype(np.uint64))
    text = np.zeros((steps, k), np.int64)
    text[np.concatenate([np.arange(len(s)) for s in y]), np.repeat(np.arange(k), n)] = code[len(own) :]
    up, down = np.full((words, k), ~np.uint64(0)), np.zeros((words, k), np.uint64)
    out = np.empty((steps + 1, k), np.int64)
    out[0] = m
    last, top = np.maximum(m - 1, 0) >> 6, (np.maximum(m - 1, 0) & 63).astype(np.uint64)
    ends = [np.where(last == w, top, np.uint64(63)) for w in range(words)]
    here = [np.flatnonzero(last == w) for w in range(words)]
    have, text = have.reshape(words, -1), text * k + np.arange(k)
    ones, zeros = np.ones(k, np.uint64), np.zeros(k, np.uint64)
    for j in range(steps):
        rises, falls = ones, zeros
        for w in range(words):
            eq, p, q = have[w].take(text[j]), up[w], down[w]
            v = eq | q
            eq |= falls
            h = eq & p
            h += p
            h ^= p
            h |= eq
            fall, rise = p & h, ~(h | p)
            rise |= q
            above, below = rise >> ends[w], fall >> ends[w]
            above &= one
            below &= one
            if len(here[w]) == k:
                out[j + 1] = out[j] + above.view(np.int64) - below.view(np.int64)
            elif len(here[w]):
                out[j + 1, here[w]] = out[j, here[w]] + above.view(np.int64)[here[w]] - below.view(np.int64)[here[w]]
            rise <<= one
            rise |= rises
            fall <<= one
            fall |= falls
            np.bitwise_and(rise, v, out=q)
            rise |= v
            np.invert(rise, out=rise)
            np.bitwise_or(fall, rise, out=p)
            rises, falls = above, below
    out[:, m == 0] = np.arange(steps + 1)[:, None]
    return out.T


def prefix_similarities(a: Column, b: Column, sizes: Column) -> Column:
    """The similarity of a text with beginnings of another, of ``sizes`` characters each: all of one
    pair's are read off one table of distances."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, cuts: pd.Series) -> pd.Series:
        x, y, cuts = x.tolist(), y.tolist(), [np.asarray(c, np.int64) for c in cuts]
        out: list = [None] * len(x)
        short = sorted((i for i in range(len(x)) if len(x[i]) <= PAIR_CHARS), key=lambda i: (len(x[i]), len(y[i])))
        for k in range(0, len(short), PAIRS):
            some = short[k : k + PAIRS]
            for i, row in zip(some, distances([x[i] for i in some], [y[i] for i in some]), strict=True):
                out[i] = row[cuts[i]]
        for i in range(len(x)):
            found = np.array(long_distances(x[i], y[i]))[cuts[i]] if out[i] is None else out[i]
            longest = np.maximum(cuts[i], len(x[i]))
            out[i] = np.where(longest == 0, 1.0, 1 - found / np.maximum(longest, 1))
        return pd.Series(out, dtype=object)

    return run(a, b, sizes)


#: Groups into which a text's starts are dealt, so that one with very many is no single row.
DEALT = 16


def windows(starts: DataFrame, passages: DataFrame, texts: DataFrame, slack: int = 0) -> DataFrame:
    """The text's words at each start, at lengths of the passage's +- slack, and their similarity.

    A text's starts go to the text, which is read once and gives a short cut for
    each; no row holds a whole text for one start.
    """
    p = passages.select(F.col("id").alias("passage_id"), F.col("words").alias("pwords"))
    sized = starts.join(p.select("passage_id", F.size("pwords").alias("size")), "passage_id")
    own = [c for c in starts.columns if c != "text_id"]
    per = sized.groupBy("text_id", F.pmod(F.xxhash64("passage_id"), F.lit(DEALT)).alias("dealt")).agg(F.collect_list(F.struct(*own, "size")).alias("starts"))
    t = texts.select(F.col("id").alias("text_id"), F.col("words").alias("twords"))
    ahead = lambda x: F.least(x.start, F.lit(0))
    cut = lambda x: F.slice("twords", (F.greatest(x.start, F.lit(0)) + 1).cast("int"), F.greatest(x["size"] + slack + ahead(x), F.lit(1)).cast("int"))
    rows = per.join(t, "text_id").select("text_id", F.explode(F.transform("starts", lambda x: F.struct(*[x[c].alias(c) for c in own], cut(x).alias("cut")))).alias("x")).select("text_id", "x.*")
    rows = rows.join(p, "passage_id").withColumn("ns", F.sequence(F.greatest(F.size("pwords") - slack, F.lit(1)), F.size("pwords") + slack))
    chars = F.transform("ns", lambda n: F.length(F.array_join(F.slice("cut", F.lit(1), F.greatest(n + F.least("start", F.lit(0)), F.lit(1)).cast("int")), " ")))
    rows = rows.withColumns({"passage": F.array_join("pwords", " "), "_whole": F.array_join("cut", " "), "chars": chars}).drop("pwords", "cut")
    rows = rows.withColumn("_s", prefix_similarities(F.col("passage"), F.col("_whole"), F.col("chars")))
    rows = rows.withColumn("_x", F.explode(F.arrays_zip("ns", "chars", "_s")))
    rows = rows.withColumns({"n": F.col("_x.ns"), "window": F.left("_whole", F.col("_x.chars")), "similarity": F.round("_x._s", 6)})
    return rows.drop("ns", "chars", "_s", "_x", "_whole")


def classify(sim: Column, ops: Column | None = None) -> Column:
    """exact, minor_variant or mismatch; with diff operations a minor variant has at most two
    one-word replacements of similar words."""
    if ops is None:
        return F.when(sim == 1, "exact").when(sim >= LIMITS.minor_similarity, "minor_variant").otherwise("mismatch")
    one = F.forall(ops, lambda o: (o.op == "replace") & (F.size(o.printed) == 1) & (F.size(o.reference) == 1) & (similarity(o.printed[0], o.reference[0]) >= LIMITS.accept_similarity))
    return F.when(F.size(ops) == 0, "exact").when(sim < LIMITS.minor_similarity, "mismatch").when((F.size(ops) <= 2) & one, "minor_variant").otherwise("mismatch")


_WORDS = T.ArrayType(T.StringType())
_DIFF = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("printed", _WORDS), T.StructField("reference", _WORDS), T.StructField("at", T.IntegerType())]))


def word_diff(printed: Column, reference: Column) -> Column:
    """Differences of two word arrays, without equal runs."""

    @F.pandas_udf(_DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = list(x), list(y)
            match = difflib.SequenceMatcher(None, x, y, autojunk=False)
            return [{"op": tag, "printed": x[i:j], "reference": y[k:m], "at": i} for tag, i, j, k, m in match.get_opcodes() if tag != "equal"]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(printed, reference)


def runs(texts: DataFrame, passages: DataFrame, n: int = 3, least: int = LIMITS.least_run) -> DataFrame:
    """(text_id, first, last, n_words): maximal runs of words covered by n-grams of the passages."""
    hits = meeting(ngrams(texts, n), ngrams(passages, n), "gram")
    w = Window.partitionBy("id").orderBy("pos")
    fresh = hits.withColumn("new", (F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(-10)) > n).cast("int"))
    # Hits at most n apart cover touching words, so they belong to one run.
    marked = fresh.withColumn("island", F.sum("new").over(w))
    out = marked.groupBy(F.col("id").alias("text_id"), "island").agg(F.min("pos").alias("first"), (F.max("pos") + n - 1).alias("last"))
    return out.withColumn("n_words", F.col("last") - F.col("first") + 1).where(F.col("n_words") >= least).drop("island")


def idf(texts: DataFrame) -> DataFrame:
    """(word, df, idf) with idf = ln(N / df) over the texts' distinct words."""
    n = texts.agg(F.count("*").alias("total"))
    df = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("word", "df", F.round(F.log(F.col("total") / F.col("df")), 6).alias("idf"))


def weighted_overlap(pairs: DataFrame, passages: DataFrame, texts: DataFrame, weights: DataFrame, unknown: float = LIMITS.unknown_idf) -> DataFrame:
    """(passage_id, text_id, overlap): idf-weighted share of the passage's words in the text."""
    w = passages.select(F.col("id").alias("passage_id"), F.posexplode("words").alias("pos", "word")).join(weights.select("word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(unknown)))
    t = texts.select(F.col("id").alias("text_id"), "words")
    rows = pairs.select("passage_id", "text_id").distinct().join(w, "passage_id").join(t, "text_id")
    share = F.sum(F.when(F.array_contains("words", F.col("word")), F.col("idf")).otherwise(F.lit(0.0))) / F.sum("idf")
    return rows.groupBy("passage_id", "text_id").agg(F.round(F.when(F.sum("idf") > 0, share).otherwise(F.lit(1.0)), 4).alias("overlap"))


def verify_spans(candidates: DataFrame) -> DataFrame:
    """Adds diff operations and the class to windows (passage, window, similarity)."""
    ops = word_diff(F.split("window", " "), F.split("passage", " "))
    return candidates.withColumn("diff", ops).withColumn("status", classify(F.col("similarity"), F.col("diff")))
