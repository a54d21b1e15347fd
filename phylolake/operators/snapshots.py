"""Differences between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: list[str], delivered: str, fields: dict[str, Column]) -> DataFrame:
    """One row per key: the fields of the row delivered last.

    Rows with the same delivery time are ordered by their field values, so the
    result does not depend on the order of arrival; a null delivery time is the
    oldest. The maximum is partial-aggregated before the shuffle.
    """
    last = F.max(F.struct(F.col(delivered), *[v.alias(n) for n, v in fields.items()])).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__last.{n}").alias(n) for n in fields])


def snapshot_changes(df: DataFrame, snapshot: str, key: str, fields: list[str], snapshots: list[int]) -> DataFrame:
    """(snapshot, key, change_kind, changed_fields) for every pair of consecutive snapshots.

    ``df`` has one row per (snapshot, key). Each row is unpivoted into signed
    cells (pair, key, field, value): plus one towards the pair it closes, minus
    one towards the pair it opens, together with a presence marker. Equal values
    cancel; what is left of the markers says added or removed, and keys present
    on both sides with a remaining cell are changed. ``change_kind`` is
    'added', 'removed' or 'changed'; the fields are listed only for the latter.

    Everything after the exchange on the key is local to it. Null is a value of
    its own. Snapshots outside ``snapshots`` are ignored; with fewer than two
    nothing is reported.
    """
    snapshots = sorted(int(s) for s in set(snapshots))
    follow = dict(zip(snapshots, snapshots[1:], strict=False))
    if not follow:
        return df.where(F.lit(False)).select(snapshot, key, F.lit("").alias("change_kind"), F.array().cast("array<string>").alias("changed_fields"))
    next_of = F.create_map(*[F.lit(x) for pair in follow.items() for x in pair])
    s = F.col(snapshot)
    sides = F.array(
        F.struct(F.when(s.isin(list(follow.values())), s).alias("pair"), F.lit(1).alias("sign")),
        F.struct(F.try_element_at(next_of, s).alias("pair"), F.lit(-1).alias("sign")),
    )
    cells = F.array(
        F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields],
    )
    unpivoted = (
        df.where(s.isin(snapshots))
        .repartition(F.col(key))
        .select(s, F.col(key), *fields, F.explode(sides).alias("__side"))
        .where("__side.pair IS NOT NULL")
        .select(F.col(key), F.col("__side.pair").alias("__pair"), F.col("__side.sign").alias("__sign"), F.explode(cells).alias("__cell"))
        .select(key, "__pair", "__sign", "__cell.field", "__cell.value")
    )
    left = unpivoted.groupBy(key, "__pair", "field", "value").agg(F.sum("__sign").alias("__n"))
    rows = left.groupBy(key, "__pair").agg(
        F.sum(F.when(F.col("field").isNull(), F.col("__n"))).alias("__present"),
        F.array_sort(F.collect_set(F.when(F.col("field").isNotNull() & (F.col("__n") != 0), F.col("field")))).alias("__fields"),
    )
    kind = (
        F.when(F.col("__present") > 0, F.lit("added")).when(F.col("__present") < 0, F.lit("removed")).when(F.size("__fields") > 0, F.lit("changed"))
    )
    return (
        rows.select(F.col("__pair").alias(snapshot), key, kind.alias("change_kind"), "__fields")
        .where("change_kind IS NOT NULL")
        .withColumn("changed_fields", F.when(F.col("change_kind") == "changed", F.col("__fields")).otherwise(F.array().cast("array<string>")))
        .drop("__fields")
    )
