"""Interval algebra on half-open ranges [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def union_length(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", name: str = "covered") -> DataFrame:
    """Positions covered at least once, per key: each range adds what lies beyond all ranges that start before it."""
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(order), F.col(start))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.col("reach")))
    return df.withColumn("reach", reach).groupBy(*keys).agg(F.coalesce(F.sum(fresh), F.lit(0)).cast("long").alias(name))


def islands(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", gap: int = 0) -> DataFrame:
    """Maximal unions of ranges that overlap, touch, or lie at most ``gap`` apart: keys, s, e, parts."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("reach").isNull() | (F.col(start) > F.col("reach") + gap)).cast("int")
    marked = df.withColumn("reach", reach).withColumn("island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count(F.lit(1)).alias("parts")).drop("island")
