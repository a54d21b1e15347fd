"""Dangling references from signed reference and existence counts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["space", "period", "key"]


def reference_deltas(df: DataFrame, space: str, period: str, key: str, sign: int = 1) -> DataFrame:
    """(space, period, key, refs, present) with ``sign`` per referencing row; null and 0 refer to nothing."""
    k = F.col(key).cast("bigint")
    return df.where(k.isNotNull() & (k != 0) & F.col(period).isNotNull()).select(
        F.lit(space).alias("space"), F.col(period).cast("int").alias("period"), k.alias("key"),
        F.lit(sign).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("present"),
    )


def presence_deltas(df: DataFrame, space: str, period: str, key: str, sign: int = 1) -> DataFrame:
    """(space, period, key, refs, present) with ``sign`` per row that makes the key exist."""
    k = F.col(key).cast("bigint")
    return df.where(k.isNotNull() & F.col(period).isNotNull()).select(
        F.lit(space).alias("space"), F.col(period).cast("int").alias("period"), k.alias("key"),
        F.lit(0).cast("bigint").alias("refs"), F.lit(sign).cast("bigint").alias("present"),
    )


def lifespan_deltas(df: DataFrame, space: str, start: str, end: str, key: str, periods: list[int]) -> DataFrame:
    """Existence of keys that live from ``start`` up to but not including ``end``.

    A null end never ends; a null start has always existed. ``periods`` are the
    (few) periods to report on.
    """
    alive = F.filter(
        F.array(*[F.lit(int(p)) for p in periods]) if periods else F.array().cast("array<int>"),
        lambda p: (F.col(start).isNull() | (p >= F.col(start))) & (F.col(end).isNull() | (p < F.col(end))),
    )
    return presence_deltas(df.select(F.explode(alive).alias("__p"), F.col(key).alias("__k")), space, "__p", "__k")


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """New counts per key after the deltas; keys whose counts are both zero vanish.

    Sums are partial-aggregated before the only shuffle, so a key with a third of
    all references arrives as one partial per input task. Arrival order does not
    matter: a target that arrives after its references simply turns the count.
    """
    parts = [*([state] if state is not None else []), *deltas]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return (
        every.groupBy(*KEY)
        .agg(F.sum("refs").alias("refs"), F.sum("present").alias("present"))
        .where((F.col("refs") != 0) | (F.col("present") != 0))
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references and no existence."""
    return state.where((F.col("refs") > 0) & (F.col("present") <= 0)).select(*KEY, "refs")


def orphan_rows(df: DataFrame, marked: DataFrame, space: str, period: str, key: str, row: str, heavy_refs: int) -> DataFrame:
    """Rows of ``df`` whose reference is an orphan: (rel_nr, row_nr), each row once.

    ``marked`` holds (space, period, key, refs, orphan) of all orphans and of all
    keys with at least ``heavy_refs`` references. The heavy ones are at most
    total/heavy_refs keys, whatever the size of the data, and are broadcast; they
    never enter the shuffle. All other keys meet their rows in a hash join.
    """
    mine = marked.where(F.col("space") == space).select("period", "key", "refs", "orphan")
    rows = df.select(F.col(period).cast("int").alias("period"), F.col(key).cast("bigint").alias("key"), F.col(row).alias("row_nr")).where(
        F.col("key").isNotNull() & (F.col("key") != 0) & F.col("period").isNotNull()
    )
    heavy = mine.where(F.col("refs") >= heavy_refs).select("period", "key", "orphan")
    light = mine.where(F.col("refs") < heavy_refs).select("period", "key")
    of_heavy = rows.join(F.broadcast(heavy.where("orphan").drop("orphan")), ["period", "key"], "left_semi")
    of_light = rows.join(F.broadcast(heavy.drop("orphan")), ["period", "key"], "left_anti").join(light, ["period", "key"], "left_semi")
    return of_heavy.unionByName(of_light).select(F.col("period").alias("rel_nr"), "row_nr").dropDuplicates()
