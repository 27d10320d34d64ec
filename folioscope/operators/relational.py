"""Joins and ranks that need more than one built-in operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides are merged and one window carries the last right row forward: one
    shuffle on the keys, no range join.
    """
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*value).alias("v")).schema["v"].dataType))  # noqa: E741
    r = right.select(*keys, at, F.lit(0).alias("_side"), F.struct(*value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in value])


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows with low <= at < high: ranges are spread over bins of ``width``, points meet them by bin."""
    p = points.withColumn("_bin", F.floor(at / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return p.join(r, "_bin").where((at >= low) & (at < high)).drop("_bin")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
