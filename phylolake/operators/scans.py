"""Scans: filtered reads, point and range lookups, pages and chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.errors import InvalidId


def read_where(df: DataFrame, condition: str | Column, values: dict | None = None, field: str | None = None) -> DataFrame:
    """Rows that meet a condition, or one column of them.

    ``condition`` may name parameters as ``:name``, bound from ``values`` (never pasted
    into the text). An empty result keeps the requested column's type.
    """
    if isinstance(condition, str) and values:
        out = df.sparkSession.sql(f"SELECT * FROM {{df}} WHERE {condition}", args=values, df=df)
    else:
        out = df.where(condition)
    return out if field is None else out.select(field)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def the_one(df: DataFrame, key: str, value):
    """The only row of a key; none or several raise."""
    rows = point(df, key, value).limit(2).collect()
    if len(rows) != 1:
        raise InvalidId(f"{'no' if not rows else 'more than one'} row with {key} = {value!r}")
    return rows[0]


def in_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Closed range."""
    return df.where(F.col(key).between(low, high))


def page(df: DataFrame, order: list[str], start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... below stop in a total order."""
    if step == 1:
        out = df.orderBy(*order).offset(start)
        return out if stop is None else out.limit(max(0, stop - start))
    n = F.row_number().over(Window.orderBy(*order)) - 1
    cond = (F.col("__n") >= start) & ((F.col("__n") - start) % step == 0)
    return df.withColumn("__n", n).where(cond if stop is None else cond & (F.col("__n") < stop)).drop("__n")


def chunks(df: DataFrame, rows: int) -> Iterator[list]:
    """Lists of at most ``rows`` rows, fetched one partition after the other."""
    part: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        part.append(r)
        if len(part) == rows:
            yield part
            part = []
    if part:
        yield part


def count_values(df: DataFrame, key: str, low, high=None) -> int:
    """Rows with a value in the closed range (or equal to ``low``); an unknown column raises KeyError."""
    if key not in df.columns:
        raise KeyError(key)
    return df.where(F.col(key) == low if high is None else F.col(key).between(low, high)).count()
