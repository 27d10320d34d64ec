"""Alignments of readings with each other and with places on a page.

Alignments are stdlib diffs in Arrow batches, always of one block at a time;
what follows from them is window and join logic.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.constants import LIMITS
from folioscope.functions import textnorm as N

_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("at", "first", "last")]))
_MATCHES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("other", T.IntegerType()), T.StructField("exact", T.BooleanType())]))


def _opcodes(a, b):
    return difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes()


def span_map(source: Column, target: Column) -> Column:
    """For each source word the span of target words [first, last): one to one in equal runs and
    replacements of the same length, else the whole run."""

    @F.pandas_udf(_SPANS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            out = []
            for tag, i, j, k, m in _opcodes(x, y):
                single = tag == "equal" or (tag == "replace" and j - i == m - k)
                out += [{"at": p, "first": k + p - i if single else k, "last": k + p - i + 1 if single else m} for p in range(i, j)]
            return out

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(source, target)


def matched_words(keys: Column, ocr_keys: Column, least: float = LIMITS.accept_similarity) -> Column:
    """Places of a block's words among OCR words: equal runs, and inside replaced runs the words of
    one position whose edit distance is small for the longer one's length."""

    @F.pandas_udf(_MATCHES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            kinds = {"equal": True, "replace": False}
            return [{"at": i + d, "other": k + d, "exact": kinds[tag]} for tag, i, j, k, m in _opcodes(x, y) if tag in kinds for d in range(min(j - i, m - k))]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    def alike(m):
        x, y = F.get(keys, m.at), F.get(ocr_keys, m.other)
        return m.exact | (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)) >= least)

    return F.filter(run(keys, ocr_keys), alike)


def alignment_score(n_matched: Column, n_keys: Column) -> Column:
    """Share of a block's words that were matched, at most 1."""
    return F.round(F.when(n_keys > 0, F.least(n_matched / n_keys, F.lit(1.0))).otherwise(F.lit(0.0)), 3)


def alignment_source(score: Column, least: float = 0.3) -> Column:
    """fusion where enough of a block's words were matched, else none."""
    return F.when(score >= least, "fusion").otherwise("none")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two words, a column of the table at once in the bits of integers."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)  # where the column rises and falls by one
    for c in b:
        same = at.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(flat | up)) & full, up & flat
        distance += (right & last > 0) - (left & last > 0)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(flat | right)) & full, right & flat & full
    return distance


def token_places(keys: Column, ocr_keys: Column, least: float = 0.5) -> Column:
    """Places of tokens among OCR words: (at, other, exact). Runs of two or more equal words are exact;
    a lone equal word, and the most similar unused word of a replaced run of like length, are not."""

    @F.pandas_udf(_MATCHES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def nearest(x, y):
            """(place in x, place in y) of a replaced run: rows of a similarity table take their best open column."""
            table = np.array([[1 - edit_distance(s, t) / max(len(s), len(t)) if s and t else 0.0 for t in y] for s in x])
            for row, likeness in enumerate(table):
                column = int(likeness.argmax())
                if likeness[column] >= least:
                    table[:, column] = -1
                    yield row, column

        def one(x, y):
            x, y, out = list(x), list(y), []
            for tag, i, j, k, m in _opcodes(x, y):
                short, long = sorted((j - i, m - k))
                if tag == "equal":
                    out += [{"at": i + d, "other": k + d, "exact": short > 1} for d in range(short)]
                elif tag == "replace" and long <= 2 * short + 1:
                    out += [{"at": i + p, "other": k + q, "exact": False} for p, q in nearest(x[i:j], y[k:m])]
            return out

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(keys, ocr_keys)


def keep_weak_hits(hits: DataFrame, most_lines: int = 6) -> DataFrame:
    """Hits (block, tok, line, exact): approximate ones stay if they lie between the lines of the
    nearest exact ones around them (where there are any), and those are at most ``most_lines`` apart."""
    before = Window.partitionBy("block").orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("block").orderBy("tok").rowsBetween(1, Window.unboundedFollowing)
    strong = F.when(F.col("exact"), F.col("line"))
    rows = hits.withColumn("_lo", F.last(strong, ignorenulls=True).over(before)).withColumn("_hi", F.first(strong, ignorenulls=True).over(after))
    inside = F.coalesce(F.col("line") >= F.col("_lo"), F.lit(True)) & F.coalesce(F.col("line") <= F.col("_hi"), F.lit(True)) & F.coalesce(F.col("_hi") - F.col("_lo") <= most_lines, F.lit(True))
    return rows.where(F.col("exact") | inside).drop("_lo", "_hi")


def locate(tokens: DataFrame) -> DataFrame:
    """Adds ``place`` to tokens (block, tok, line, x0, x1, exact; nulls where unread): word, approx,
    gap (both neighbours at most two away on one line, right to left), else uncertain."""
    w = Window.partitionBy("block").orderBy("tok")
    known = F.when(F.col("line").isNotNull(), F.struct("tok", "line", "x0", "x1"))
    rows = tokens.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_a", F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    near = (F.col("tok") - F.col("_b.tok") <= 2) & (F.col("_a.tok") - F.col("tok") <= 2) & (F.col("_b.line") == F.col("_a.line")) & (F.col("_a.x1") <= F.col("_b.x0"))
    place = F.when(F.col("exact"), "word").when(F.col("line").isNotNull(), "approx").when(F.coalesce(near, F.lit(False)), "gap").otherwise("uncertain")
    out = rows.withColumn("place", place)
    return out.withColumn("x0", F.when(place == "gap", F.col("_a.x1")).otherwise(F.col("x0"))).withColumn("x1", F.when(place == "gap", F.col("_b.x0")).otherwise(F.col("x1"))).withColumn("line", F.when(place == "gap", F.col("_b.line")).otherwise(F.col("line"))).drop("_a", "_b")


def tighten(boxes: DataFrame, words: DataFrame, margin: int = 15, pad: int = 6, least: float = LIMITS.accept_similarity) -> DataFrame:
    """Boxes (page, block, keys, x0..y1) snapped to OCR words (page, key, x0..y1) whose centre lies
    within ``margin`` and that resemble a word of the block; at least a third of its words must."""
    b = boxes.select("page", "block", "keys", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= F.col("bx0") - margin) & (cx <= F.col("bx1") + margin) & (cy >= F.col("by0") - margin) & (cy <= F.col("by1") + margin)
    alike = F.exists("keys", lambda k: 1 - F.levenshtein(k, F.col("key")) / F.greatest(F.length(k), F.length("key"), F.lit(1)) >= least)
    hits = b.join(words, "page").where(inside & alike).groupBy("page", "block").agg(F.count("*").alias("hits"), F.min("x0").alias("hx0"), F.min("y0").alias("hy0"), F.max("x1").alias("hx1"), F.max("y1").alias("hy1"))
    rows = boxes.join(hits, ["page", "block"], "left").withColumn("snapped", F.coalesce(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.size("keys") / 3)), F.lit(False)))
    for c, d in (("x0", -pad), ("y0", -pad), ("x1", pad), ("y1", pad)):
        rows = rows.withColumn(c, F.when(F.col("snapped"), F.col(f"h{c}") + d).otherwise(F.col(c)))
    return rows.drop("hits", "hx0", "hy0", "hx1", "hy1")


def best_matches(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Of pairs (id, other, a, b) the best match of each id by text ratio, if above ``least``; the
    first of equal ones (smallest other) counts."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    scored = pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") > least)
    w = Window.partitionBy("id").orderBy(F.desc("ratio"), "other")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "a", "b")


def resolve_equivalent(items: DataFrame, stable: bool = False) -> DataFrame:
    """Undecided items (a, b, c, decision) whose second and third readings print alike, with the
    first absent or of the same letters, are decided for the second; human decisions stay."""
    same = (N.canon(F.col("b"), stable) == N.canon(F.col("c"), stable)) & (F.col("a").isNull() | (N.letters_key(F.col("a"), stable) == N.letters_key(F.col("b"), stable)))
    auto = F.col("decision").isNull() & F.coalesce(same, F.lit(False))
    return items.withColumn("auto", auto).withColumn("decision", F.when(auto, F.col("b")).otherwise(F.col("decision")))


def replay(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(block, text): tokens (block, tok, raw) with decided spans (block, first, last, decision) put
    in their place ('' deletes); blocks with an undecided span have a null text."""
    covered = spans.select("block", F.explode(F.sequence("first", "last")).alias("tok"))
    kept = tokens.join(covered, ["block", "tok"], "left_anti").select("block", "tok", F.col("raw").alias("t"))
    put = spans.where("decision <> ''").select("block", F.col("first").alias("tok"), F.col("decision").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "t"))), lambda s: s.t), " ")
    out = tokens.select("block").distinct().join(kept.unionByName(put).groupBy("block").agg(text.alias("text")), "block", "left")
    undecided = spans.where("decision is null").select("block").distinct().withColumn("_u", F.lit(True))
    return out.join(undecided, "block", "left").select("block", F.when(F.col("_u").isNull(), F.coalesce("text", F.lit(""))).alias("text"))
