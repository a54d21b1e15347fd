"""All-against-all matches of genome pairs with their quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ("is_stable", "is_verified", "is_canonical")


def view(matches: DataFrame, kind: str, *, canonical_only: bool = False) -> DataFrame:
    """Matches by quality: all, best (BM), stable (SP) or verified pairs (VP)."""
    out = {"ALL": matches, "BM": matches, "SP": matches.where("is_stable"), "VP": matches.where("is_verified")}[kind]
    return out.where("is_canonical") if canonical_only else out


def of_genomes(matches: DataFrame, g1: str, g2: str) -> DataFrame:
    return matches.where((F.col("genome1") == g1) & (F.col("genome2") == g2))


def set_flag(matches: DataFrame, wanted: DataFrame, flag: str, *, entries: DataFrame | None = None) -> DataFrame:
    """Matches with ``flag`` true for the pairs in ``wanted`` and false for the others (of ``entries``, if given).

    A wanted pair without a match raises when the plan is built.
    """
    if flag not in FLAGS:
        raise ValueError(f"unknown flag {flag!r}")
    keys = ["entry_nr1", "entry_nr2"]
    lost = wanted.join(matches, keys, "left_anti").limit(5).collect()
    if lost:
        raise KeyError(f"no match for {[tuple(r) for r in lost]}")
    j = matches.join(wanted.select(*keys).distinct().withColumn("__w", F.lit(True)), keys, "left")
    value = F.coalesce("__w", F.lit(False))
    if entries is not None:
        j = j.join(entries.select(F.col("entry_nr").alias("entry_nr1")).distinct().withColumn("__mine", F.lit(True)), "entry_nr1", "left")
        value = F.when(F.col("__mine"), value).otherwise(F.col(flag))
    return j.withColumn(flag, value).select(*matches.columns)
