"""Per-key aggregates when a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.session import spill, work_slots

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def fan_in_rounds(partitions: int, fan_in: int) -> int:
    """Merge rounds needed so that no merge sees more than ``fan_in`` partial states of a key."""
    return max(1, math.ceil(math.log(max(partitions, 2), fan_in)))


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, tuple[str, str | None]],
    *,
    chunk_rows: int = 1 << 17,
    fan_in: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """Aggregate per key through chunks and logarithmic fan-in rounds.

    ``aggs`` maps an output name to (``count|sum|min|max``, column); the column
    of ``count`` may be None for rows, else non-null values count. Rows are cut
    into chunks of ``chunk_rows`` inside their input partition; a chunk's rows of
    one key become one state before anything moves. Every following round merges
    at most ``fan_in`` states of a key in one task, so a key that holds a third
    of all rows never sends all its partials to a single reducer.

    Null keys form a group of their own, as in GROUP BY. An empty table gives an
    empty result. Columns not named are ignored, whatever they are called.
    """
    n = partitions or max(2, df.sparkSession.sparkContext.defaultParallelism)
    rounds = fan_in_rounds(n, fan_in)
    slots = fan_in**rounds
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    values = [(F.lit(1) if col is None else F.col(col)).alias(f"__v{i}") for i, (_, col) in enumerate(aggs.values())]
    at = F.monotonically_increasing_id()
    chunk = F.shiftright(at, 33) * F.lit(1 << 20) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(chunk_rows))
    rows = df.select(*k, *values, F.pmod(F.xxhash64(chunk), F.lit(slots)).alias("__slot"))
    names = [f"__k{i}" for i in range(len(keys))]
    first = [
        (F.count(F.col(f"__v{i}")) if kind == "count" else _MERGE[kind](F.col(f"__v{i}"))).alias(f"__v{i}")
        for i, (kind, _) in enumerate(aggs.values())
    ]
    merge = [_MERGE[kind](F.col(f"__v{i}")).alias(f"__v{i}") for i, (kind, _) in enumerate(aggs.values())]
    state = rows.groupBy(*names, "__slot").agg(*first)
    for _ in range(rounds - 1):
        state = state.withColumn("__slot", F.floor(F.col("__slot") / F.lit(fan_in))).groupBy(*names, "__slot").agg(*merge)
    state = state.groupBy(*names).agg(*merge)
    return state.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)],
        *[F.col(f"__v{i}").alias(name) for i, name in enumerate(aggs)],
    )


def dominant_keys(df: DataFrame, key: str, share_percent: int, **tree) -> DataFrame:
    """Keys that hold at least ``share_percent`` percent of all rows: (key, n_rows, n_total).

    The total counts every row, also those whose key is null; a null key is
    never reported. An empty table has no dominant key.
    """
    counts = tree_aggregate(df, [key], {"n_rows": ("count", None)}, **tree)
    total = df.count()  # one number, from the files' row counts
    return (
        counts.where(F.col(key).isNotNull() & (F.col("n_rows") * 100 >= F.lit(total * share_percent)))
        .select(key, "n_rows", F.lit(total).cast("bigint").alias("n_total"))
    )


def salted_sides(df: DataFrame, keys: list[str], *, rows_per_salt: int = 500) -> tuple[DataFrame, DataFrame]:
    """Two copies of ``df`` for a self-join on ``keys`` and ``__salt`` that splits heavy keys over many tasks.

    The left copy gives every row one salt, the right one repeats the rows of
    heavy keys for each salt, so every pair of rows with equal keys meets exactly once. A key has one salt per
    ``rows_per_salt`` of its own rows, however large the table is. The heavy keys are a written table: Spark broadcasts it
    only if its files are small, else it is joined by shuffle, where the rows of a hot key can be split.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = spill(counts.where(F.col("__n") > rows_per_salt).select(*keys, F.ceil(F.col("__n") / rows_per_salt).cast("int").alias("__salts")), "salts")
    sized = df.join(heavy, keys, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    others = [c for c, kind in df.dtypes if c not in keys and not kind.startswith("map")]
    n = work_slots(df.sparkSession)
    left = sized.withColumn("__salt", F.pmod(F.xxhash64(*others), F.col("__salts")).cast("int")).drop("__salts")
    right = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    # a fixed number of partitions: the inputs are small beside the pairs they make, coalescing would undo the spread
    return left.repartition(n, *keys, "__salt"), right.repartition(n, *keys, "__salt")


def skewed_lookup(rows: DataFrame, dim: DataFrame, on: list[str], *, max_heavy: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``dim`` (one row per key) when a few keys hold most rows.

    The at most ``max_heavy`` keys with more than rows / ``max_heavy`` rows meet their
    ``dim`` rows by broadcast and are never shuffled; all others by a hash join.
    """
    total = rows.count()
    heavy = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1000, total // max_heavy)).drop("__n")
    heavy_dim = F.broadcast(dim.join(F.broadcast(heavy), on, "left_semi"))
    light = rows.join(F.broadcast(heavy), on, "left_anti").join(dim, on)
    return rows.join(heavy_dim, on).unionByName(light)
