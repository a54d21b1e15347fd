"""Confidence of homoeolog pairs: a small fuzzy rule system in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylolake.session import spill

LEVELS = ("low", "med", "high")
# Level of confidence for synteny and distance (rows) and low, medium or high copy number.
RULES = {
    ("low", "low"): ("med", "med", "med"),
    ("low", "med"): ("med", "med", "low"),
    ("low", "high"): ("low", "low", "very_low"),
    ("med", "low"): ("high", "high", "high"),
    ("med", "med"): ("med", "med", "med"),
    ("med", "high"): ("med", "med", "low"),
    ("high", "low"): ("very_high", "high", "high"),
    ("high", "med"): ("high", "high", "high"),
    ("high", "high"): ("high", "high", "med"),
}
# Centre and width of the Gaussian of each level of confidence.
CONFIDENCE = {"very_low": (0.0, 20.0), "low": (50.0, 10.0), "med": (70.0, 10.0), "high": (90.0, 10.0), "very_high": (100.0, 10.0)}


def memberships(max_distance: float, median_copies: float, max_copies: float) -> dict[str, dict[str, tuple[float, float]]]:
    """Centre and width of the Gaussian memberships; distance and copy number follow the data."""
    return {
        "distance": {"low": (0.0, max_distance / 10), "med": (max_distance / 4, max_distance / 10), "high": (max_distance, max_distance / 2.5)},
        "synteny": {"low": (0.0, 0.15), "med": (0.3, 0.15), "high": (1.0, 0.4)},
        "copies": {"low": (median_copies, median_copies), "med": (4 * median_copies, 1.5 * median_copies), "high": (max_copies, max_copies / 2.5)},
    }


def gaussian(x: Column, centre: float, width: float) -> Column:
    return F.exp(-F.pow(x - centre, 2) / (2 * width * width))


def fuzzy_confidence(distance: Column, synteny: Column, copies: Column, shape: dict) -> Column:
    """Centroid over 0..100 of the confidence levels, each cut at the strength of its rules (min for and, max for or)."""
    values = {"distance": distance.cast("double"), "synteny": synteny.cast("double"), "copies": copies.cast("double")}
    m = {k: {lvl: gaussian(values[k], *p) for lvl, p in lv.items()} for k, lv in shape.items()}
    strength: dict[str, list[Column]] = {k: [] for k in CONFIDENCE}
    for (s, d), outcome in RULES.items():
        for c, level in zip(LEVELS, outcome, strict=True):
            strength[level].append(F.least(m["synteny"][s], m["distance"][d], m["copies"][c]))
    rules = F.array(*[F.greatest(*v) if len(v) > 1 else v[0] for v in strength.values()])
    x = F.sequence(F.lit(0), F.lit(100))
    curves = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in CONFIDENCE.values()])
    height = F.transform(x, lambda i: F.array_max(F.zip_with(rules, curves, lambda r, k: F.least(r, F.exp(-F.pow(i - k["c"], F.lit(2)) / (2 * k["w"] * k["w"]))))))
    top = F.aggregate(F.zip_with(x, height, lambda i, h: i * h), F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(F.try_divide(top, F.aggregate(height, F.lit(0.0), lambda a, v: a + v)), F.lit(0.0))


def homoeolog_confidence(pairs: DataFrame, *, distance: str = "distance", synteny: str = "synteny", copies: str = "copy_nr") -> DataFrame:
    """``pairs`` with ``confidence``: fuzzy scores stretched so that they run from the smallest score to 100.

    Equal inputs are scored once. A null distance counts as the largest one, null synteny as none,
    null copies as two. An empty table stays empty.
    """
    keyed = pairs.withColumn("__s", F.coalesce(F.col(synteny), F.lit(0.0))).withColumn("__c", F.coalesce(F.col(copies), F.lit(2)))
    far, median, most = keyed.agg(F.max(distance), F.median("__c"), F.max("__c")).first()
    if most is None:
        return pairs.withColumn("confidence", F.lit(None).cast("double"))
    far = float(far or 1.0)
    keyed = keyed.withColumn("__d", F.coalesce(F.col(distance), F.lit(far)))
    score = fuzzy_confidence(F.col("__d"), F.col("__s"), F.col("__c"), memberships(far, float(median), float(most)))
    inputs = keyed.select("__d", "__s", "__c").distinct().repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)
    scored = spill(inputs.withColumn("__f", score), "confidence")
    low, high = scored.agg(F.min("__f"), F.max("__f")).first()
    spread = F.lit(100.0) if high == low else F.lit(low) + (F.col("__f") - low) * (100.0 - low) / (high - low)
    return keyed.join(scored, ["__d", "__s", "__c"]).withColumn("confidence", spread).drop("__d", "__s", "__c", "__f")


def one_per_subgenome_pair(pairs: DataFrame, *, sub1: str = "subgenome1", sub2: str = "subgenome2") -> DataFrame:
    """Pairs in the order sub1 < sub2 only, so that each homoeolog pair of two subgenomes appears once."""
    return pairs.where(F.col(sub1) < F.col(sub2)).dropDuplicates(["entry_nr1", "entry_nr2"])


def with_source_ids(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with the joined identifiers of both ends (left joins; several ids are joined by '; ')."""
    text = ids.groupBy("entry_nr").agg(F.array_join(F.array_sort(F.collect_set("xref_id")), "; ").alias("ids"))
    return pairs.join(text.toDF("entry_nr1", "source_ids1"), "entry_nr1", "left").join(text.toDF("entry_nr2", "source_ids2"), "entry_nr2", "left")
