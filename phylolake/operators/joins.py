"""Joins Spark has no equi-key for: points in intervals, overlapping intervals, nearest lower key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.errors import BoundExceeded

BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast after its row count was checked against ``limit``."""
    n = df.limit(limit + 1).count()
    if n > limit:
        raise BoundExceeded(f"more than {limit} rows cannot be broadcast")
    return F.broadcast(df)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: Column, high: Column, *, width: int, how: str = "inner") -> DataFrame:
    """Points with the closed intervals [low, high] that contain them.

    Both sides are cut into bins of ``width``; a point meets only the intervals of
    its bin, by an equi-join that Spark may broadcast or shuffle. Choose the width near the
    usual interval length: an interval spans (high - low) / width + 1 bins. Null points and
    empty intervals match nothing (``how='left'`` keeps such points).
    """
    binned = intervals.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    binned = binned.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    left = points.withColumn("__bin", F.floor(F.col(point) / width))
    inside = (left["__bin"] == binned["__bin"]) & left[point].between(binned["__low"], binned["__high"])
    return left.join(binned, inside, how).drop(left["__bin"]).drop(binned["__bin"]).drop("__low", "__high")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], *, width: int) -> DataFrame:
    """Pairs of closed intervals that overlap, with equal ``keys``; each pair once.

    A pair is reported in the bin where the later of both starts, so no
    deduplication follows. Column names of the two sides must differ, keys apart.
    """
    (al, ah), (bl, bh) = a_range, b_range

    def binned(df, lo, hi):
        return df.where(F.col(lo) <= F.col(hi)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    j = binned(a, al, ah).join(binned(b, bl, bh), [*keys, "__bin"])
    return j.where((F.col(al) <= F.col(bh)) & (F.col(bl) <= F.col(ah)) & (F.floor(F.greatest(al, bl) / width) == F.col("__bin"))).drop("__bin")


def asof_join(left: DataFrame, right: DataFrame, key: str, right_key: str, value: str, *, width: int, by: list[str] | None = None) -> DataFrame:
    """``left`` with ``value`` of the nearest row of ``right`` whose key is not above (null: none).

    Keys are cut into bins of ``width``: inside a bin the last value is carried forward, and
    what the bin starts with is carried over the (few) bins. With ties the largest
    value of the same key counts; rows of ``left`` without a key get null.
    """
    by = by or []
    bin_ = lambda c: F.floor(F.col(c) / width)
    r = right.groupBy(*by, F.col(right_key).alias(key)).agg(F.max(value).alias(value)).withColumn("__bin", bin_(key)).withColumn("__side", F.lit(0))
    lf = left.withColumn("__bin", bin_(key)).withColumn("__side", F.lit(1))
    here = Window.partitionBy(*by, "__bin").orderBy(key, "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__side") == 0, F.col(value)), ignorenulls=True).over(here)
    rows = r.unionByName(lf, allowMissingColumns=True).withColumn("__in", carried).where("__side = 1")
    bins = lf.select(*by, "__bin").distinct().withColumn("__last", F.lit(None).cast(right.schema[value].dataType))
    bins = bins.unionByName(r.groupBy(*by, "__bin").agg(F.max_by(value, key).alias("__last"))).groupBy(*by, "__bin").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = bins.select(*by, "__bin", F.last("__last", ignorenulls=True).over(before).alias("__start"))
    out = rows.join(start, [*by, "__bin"], "left").withColumn(value, F.coalesce("__in", "__start"))
    return out.drop("__bin", "__side", "__in", "__start")
