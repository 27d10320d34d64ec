"""Ranks, best places and rounding that the searches share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.constants import LIMITS


def ranked(scores: DataFrame, n: int, by: Column | None = None) -> DataFrame:
    """The n best of each query, ties to the smaller id: adds ``rank``."""
    w = Window.partitionBy("qid").orderBy(by if by is not None else F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def expand_terms(queries: DataFrame, dictionary: DataFrame, least_prefix: int = LIMITS.prefix_term_chars) -> DataFrame:
    """(qid, qterm, term): long query terms match every dictionary term they begin.

    Terms meet on their first ``least_prefix`` characters, so the expansion is an
    equi-join over the dictionary and never over postings.
    """
    d = dictionary.select("term").withColumn("head", F.substring("term", 1, least_prefix))
    q = queries.select("qid", "qterm").withColumn("head", F.substring("qterm", 1, least_prefix))
    long = q.where(F.length("qterm") >= least_prefix).join(d, "head").where(F.col("term").startswith(F.col("qterm"))).select("qid", "qterm", "term")
    short = q.where(F.length("qterm") < least_prefix).select("qid", "qterm", F.col("qterm").alias("term"))
    return long.unionByName(short)


def best(scores: np.ndarray, ids: np.ndarray, n: int, distinct: bool = True) -> np.ndarray:
    """Places of the n best scores above -inf, ties to the smaller id; of one id the best, if ``distinct``."""
    k = n
    while True:
        keep = np.arange(len(scores)) if k >= len(scores) else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        keep = keep[scores[keep] > -np.inf]
        order = keep[np.lexsort((ids[keep], -scores[keep]))]
        if not distinct:
            return order[:n]
        first = np.sort(np.unique(ids[order], return_index=True)[1])
        if len(first) >= n or k >= len(scores):
            return order[first[:n]]
        k *= 2


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six places like Spark's round."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)
