"""Functions for SQL texts: keys as vectorised functions, words as a table function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def register_functions(spark: SparkSession) -> None:
    """nfkc(text) as a function on batches; word_rows(text), a row for each word and its place, as a SQL table function."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    spark.udf.register("nfkc", nfkc)
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION word_rows(text STRING) RETURNS TABLE (pos INT, word STRING)
        RETURN SELECT p.pos, p.word FROM (SELECT posexplode(filter(split(coalesce(text, ''), r'(?U)\s+'), w -> w <> '')) AS (pos, word)) AS p"""
    )


def matched_by(df: DataFrame, match: Callable[[list[str]], list[str | None]], text: Column, out: str = "found") -> DataFrame:
    """Adds what a caller's function finds in each text; it gets the texts of a batch as a list."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(match([t for t in s]), dtype=object)

    return df.withColumn(out, run(text))
