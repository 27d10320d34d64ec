"""Fuzzy scores of texts, exact: the best window, and sets of words.

A score is 100 times twice the longest common subsequence over both lengths
(insertions and deletions count). Subsequences are counted bit-parallel: a text's
character updates a row of bits at once, in numpy for all windows of a text
together. Windows come in order of an upper bound (characters in common), so most
are never looked at; the result is the best of all of them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Windows that are evaluated together.
WINDOWS = 256
#: Texts of a block, and titles.
TEXT_BLOCK, TITLE_BLOCK = 512, 256


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        met = rest & at.get(c, 0)
        rest = ((rest + met) | (rest - met)) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _window_lengths(codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Common subsequences of a pattern, given as bit masks by character, with each row of codes."""
    n, words = len(codes), masks.shape[1]
    rest = np.full((n, words), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(codes.shape[1]):
        met = rest & masks[codes[:, k]]
        total = rest + met
        if words > 1:
            over = total < met
            for w in range(1, words):
                total[:, w] += over[:, w - 1]
                over[:, w] |= over[:, w - 1] & (total[:, w] == 0)
        rest = total | (rest - met)
    return 64 * words - np.bitwise_count(rest).sum(axis=1).astype(np.int64)


def _best_in(needle: str, text: str, least: float) -> float:
    m, n = len(needle), len(text)
    letters = np.frombuffer(needle.encode("utf-32-le"), np.uint32)
    known, own = np.unique(letters, return_inverse=True)
    body = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.minimum(np.searchsorted(known, body), len(known) - 1)
    codes = np.full(n + 2 * m - 2, len(known), np.int64)
    codes[m - 1 : m - 1 + n] = np.where(known[place] == body, place, len(known))
    # Window i has the text's characters i - m + 1 to i; the first and last ones are cut short.
    i = np.arange(n + m - 1)
    size = np.minimum(i, n - 1) - np.maximum(i - m + 1, 0) + 1
    shared = np.zeros(len(i), np.int64)
    for c, wanted in enumerate(np.bincount(own)):
        total = np.append(0, np.cumsum(codes == c))
        shared += np.minimum(total[m:] - total[:-m], wanted)
    bound = 200.0 * shared / (m + size)
    masks = np.zeros((len(known) + 1, -(-m // 64)), np.uint64)
    for k, c in enumerate(own.tolist()):
        masks[c, k >> 6] |= np.uint64(1 << (k & 63))
    best = 0.0
    order = np.argsort(-bound, kind="stable")
    step = 16
    at = 0
    while at < len(order):
        some = order[at : at + step]
        some = some[bound[some] > max(best, least - 1e-9)]
        if not len(some):
            break
        lengths = _window_lengths(codes[some[:, None] + np.arange(m)], masks)
        best = max(best, float((200.0 * lengths / (m + size[some])).max()))
        at, step = at + step, min(2 * step, WINDOWS)
    return best


def best_window(a: str | None, b: str | None, least: float = 0.0) -> float:
    """The best score of the shorter text with a window of its length in the longer, or with a shorter
    one at the longer's ends; of two of one length, either way. Empty texts have 0, two of them 100.

    With ``least`` a score below it may come out smaller than it is (not larger).
    """
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0 if a or b else 100.0
    if a == b:
        return 100.0
    if len(a) != len(b):
        a, b = sorted((a, b), key=len)
        return _best_in(a, b, least)
    return max(_best_in(a, b, least), _best_in(b, a, least))


def word_sets(a: str | None, b: str | None) -> float:
    """The best score among the texts' common words, and those with each text's own words; 100
    where one text's words contain the other's, 0 where a text has none."""
    p, q = set((a or "").split()), set((b or "").split())
    both = p & q
    if not p or not q:
        return 0.0
    if both and (both == p or both == q):
        return 100.0
    left, right, base = " ".join(sorted(p - q)), " ".join(sorted(q - p)), len(" ".join(sorted(both)))
    gap = base > 0
    sizes = base + gap + len(left), base + gap + len(right)
    score = lambda distance, total: 100.0 * (1 - distance / total)
    found = [score(len(left) + len(right) - 2 * common_length(left, right), sum(sizes))]
    if gap:
        found += [score(gap + len(x), base + s) for x, s in zip((left, right), sizes, strict=True)]
    return max(found)


def partial_ratio(a: Column, b: Column) -> Column:
    """``best_window`` of two columns, 0 to 100."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([best_window(s, t) for s, t in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """``word_sets`` of two columns, 0 to 100."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([word_sets(s, t) for s, t in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def wording_score(a: Column, b: Column) -> Column:
    """The larger of both scores: what decides whether two wordings are one report."""
    return F.greatest(token_set_ratio(a, b), partial_ratio(a, b))


def least_grams(size: int, least: float) -> int:
    """How many character pairs a text and a needle of ``size`` letters share at least, counted with
    repetition, if ``best_window`` gives them ``least`` or more.

    With a window of x letters at most (1 - r)(size + x) letters are inserted or
    deleted, x is at least r / (2 - r) of the size, a deletion breaks two pairs
    of the needle and an insertion one.
    """
    r = least / 100
    broken = max(size * (1.5 * (1 - r) + 0.5) + x * (1.5 * (1 - r) - 0.5) for x in (r / (2 - r) * size, size))
    return max(0, math.ceil(size - 1 - broken - 1e-9))


def _grams(text: str) -> list[tuple[str, int]]:
    """Character pairs, each with its number among equal ones."""
    seen: Counter = Counter()
    out = []
    for k in range(len(text) - 1):
        pair = text[k : k + 2]
        out.append((pair, seen[pair]))
        seen[pair] += 1
    return out


def _blocks(rows: DataFrame, size: int, key: str, name: str) -> tuple[DataFrame, int]:
    """(name, rows): blocks of about ``size`` rows, dealt by a hash, and how many there are."""
    count = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(*rows.columns), F.lit(count)))
    return dealt.groupBy(name).agg(F.collect_list(F.struct(*rows.columns)).alias(key)), count


def fuzzy_titles(texts: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(id, key, ext_id, text_key, score) of texts (id, key) and titles (ext_id, title_key, text_key)
    whose best window scores ``least`` or more. No such pair is lost.

    Blocks of titles meet blocks of texts. A matrix product counts the character
    pairs that each title shares with each text; pairs below the least number
    are out, and the rest are scored. (The least number is a third of a title's
    pairs at 80, so a join on a few rare pairs would let almost all through.)
    """
    left, n = _blocks(texts.select("id", "key"), TEXT_BLOCK, "texts", "t")
    right, m = _blocks(titles.select("ext_id", "title_key", "text_key"), TITLE_BLOCK, "titles", "e")
    pairs = left.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).join(right, "e").select("texts", "titles").repartition(max(2, min(n * m, 4096)))
    out_schema = T.StructType([texts.schema["id"], texts.schema["key"], titles.schema["ext_id"], titles.schema["text_key"], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out_schema)

    def run(batches):
        for b in batches:
            for rows, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                vocabulary: dict[tuple[str, int], int] = {}
                own = [[vocabulary.setdefault(g, len(vocabulary)) for g in _grams(h["title_key"])] for h in heads]
                one = np.zeros((len(heads), len(vocabulary)), np.float32)
                for k, g in enumerate(own):
                    one[k, g] = 1
                two = np.zeros((len(vocabulary), len(rows)), np.float32)
                for k, r in enumerate(rows):
                    two[[v for g in _grams(r["key"]) if (v := vocabulary.get(g)) is not None], k] = 1
                size = np.minimum(np.array([len(h["title_key"]) for h in heads])[:, None], np.array([len(r["key"]) for r in rows])[None, :])
                need = np.array([least_grams(s, least) for s in range(int(size.max(initial=0)) + 1)])[size]
                out = []
                for i, j in zip(*np.nonzero(one @ two >= need), strict=True):
                    score = best_window(heads[i]["title_key"], rows[j]["key"], least)
                    if score >= least:
                        out.append((rows[j]["id"], rows[j]["key"], heads[i]["ext_id"], heads[i]["text_key"], score))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    return pairs.mapInArrow(run, out_schema)


def match_external(reports: DataFrame, entries: DataFrame, least: float = 80.0, sure: float = 70.0, most: int = 3) -> DataFrame:
    """(id, ext_id, place, score, sure): reports (id, key) with the entries (ext_id, title_key, text_key)
    whose title they hold, confirmed by the larger of both scores of the whole texts.

    Keys of under 15 and titles of under 10 characters match nothing. A report's ``most``
    best titles (of equal scores the larger ext_id) are confirmed; nulls match nothing, and
    repeated rows count once.
    """
    r = reports.where((F.length("key") >= 15) & F.col("id").isNotNull())
    e = entries.where(F.length("title_key") >= 10)
    w = Window.partitionBy("id", "key").orderBy(F.desc("score"), F.desc("ext_id"))
    best = fuzzy_titles(r.select("id", "key").distinct(), e.select("ext_id", "title_key", "text_key").distinct(), least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return best.withColumn("sure", wording_score(F.col("text_key"), F.col("key"))).where(F.col("sure") >= sure).select("id", "ext_id", "place", "score", "sure")
