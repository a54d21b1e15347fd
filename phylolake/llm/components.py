"""Group identifiers over chains of pairwise matches.

Vertices of degree one and two are taken out round by round: whole pendant paths
and chains at once, found by list ranking (pointer doubling over directed arcs).
The reduced core is solved by alternating large-star and small-star contraction.
Labels then return to the removed vertices in reverse order. Links and labels
stay in distributed tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.operators.skew import skewed_lookup
from phylolake.session import discard, spill


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _rank_chains(chain: DataFrame) -> DataFrame:
    """(v, end1, end2, low) of every chain vertex: the vertices of higher degree at the ends of its
    chain (null: the chain just stops there) and, for chains without any, their smallest vertex.

    ``chain`` has (v, n1, n2) of the vertices of degree one (n2 null) and two.
    """
    arcs = chain.select("v", F.explode(F.array("n1", "n2")).alias("w")).where("w IS NOT NULL")
    nxt = chain.select(F.col("v").alias("w"), "n1", "n2", F.lit(True).alias("inner"))
    onward = F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1"))
    state = arcs.join(nxt, "w", "left").select(
        "v", "w",
        F.when(F.col("inner") & onward.isNotNull(), F.col("w")).alias("pv"),
        F.when(F.col("inner"), onward).alias("pw"),
        F.when(F.col("inner") & onward.isNull(), F.least("v", "w")).otherwise(F.col("v")).alias("low"),
        F.when(F.col("inner").isNull(), F.col("w")).alias("end"),
    )
    first = spill(state, "arcs")
    active, ended = first.where("pv IS NOT NULL"), first.where("pv IS NULL")
    kept, ends = [first], []
    while not active.isEmpty():
        # of the ended arcs only those that an open one points to can be asked for from now on
        pointed = active.select(F.col("pv").alias("v"), F.col("pw").alias("w"))
        ended = spill(ended.join(pointed, ["v", "w"], "left_semi"), "ends")
        ends.append(ended)
        every = active.unionByName(ended)
        to = every.select(F.col("v").alias("pv"), F.col("w").alias("pw"), F.col("pv").alias("qv"), F.col("pw").alias("qw"), F.col("low").alias("qlow"), F.col("end").alias("qend"))
        # the stretches of an arc and of the one it points to share no vertex unless they go all around a ring: then its minimum is settled
        ring = F.col("qlow") == F.col("low")
        moved = active.join(to, ["pv", "pw"]).select(
            "v", "w", F.when(~ring, F.col("qv")).alias("pv"), F.when(~ring, F.col("qw")).alias("pw"), F.least("low", "qlow").alias("low"), F.col("qend").alias("end")
        )
        new = spill(moved, "arcs")  # arcs that have ended are parked, only the others are written again
        kept.append(new)
        active, ended = new.where("pv IS NOT NULL"), ended.unionByName(new.where("pv IS NULL"))
    every = kept[0].where("pv IS NULL")
    for p in kept[1:]:
        every = every.unionByName(p.where("pv IS NULL"))
    ranked = spill(every.groupBy("v").agg(F.min("end").alias("end1"), F.max("end").alias("end2"), F.count("end").alias("n_ends"), F.min("low").alias("low")), "ranked")
    discard(*kept, *ends)
    return ranked


def _reduce(edges: DataFrame, n: int, least_gain: float) -> tuple[DataFrame, DataFrame] | None:
    """(removed, edges): one round of taking out the vertices of degree one and two; None where they are fewer than ``least_gain`` of the ``n`` links.

    ``removed`` has (v, parent); a parent outside the remaining graph is the root of its group.
    """
    degree = _both_ways(edges).groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("d"), F.min("b").alias("n1"), F.max("b").alias("n2"))
    chain = spill(degree.where("d <= 2").select("v", "n1", F.when(F.col("d") == 2, F.col("n2")).alias("n2")), "chain")
    if chain.count() <= least_gain * n:
        discard(chain)
        return None
    ranked = _rank_chains(chain)
    parent = F.coalesce(F.col("end1"), F.col("low"))
    removed = spill(ranked.select("v", parent.alias("parent")).where("v <> parent"), "removed")
    gone = chain.select("v")
    kept = edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    bridges = ranked.where("n_ends = 2 AND end1 <> end2").select(F.col("end1").alias("a"), F.col("end2").alias("b"))
    left = spill(kept.unionByName(bridges).distinct(), "edges")
    discard(chain, ranked)
    return removed, left


def _star_contraction(edges: DataFrame) -> DataFrame:
    """(v, label): every non-root vertex of the core with its group's smallest vertex."""

    def large(e):
        d = _both_ways(e)
        low = spill(d.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")  # a plain table, so that the join of a hub can be split
        used.append(low)
        return d.where("b > a").join(low, "a").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).where("a <> b")

    def small(e):
        low = spill(e.groupBy("b").agg(F.min("a").alias("m")), "lowest")
        used.append(low)
        near = e.join(low, "b").select(F.col("a").alias("x"), "m").unionByName(low.select(F.col("b").alias("x"), "m"))
        return near.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    used: list[DataFrame] = []
    seen = -1
    while True:
        big = spill(large(edges), "stars")
        new = spill(small(big), "stars")
        n = new.count()
        discard(edges, big, *used)
        used.clear()
        edges = new
        if n == seen:  # done when all links are stars: no centre is a leaf, no leaf has two centres
            chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi")
            if chained.isEmpty() and edges.groupBy("b").count().where("count > 1").isEmpty():
                return edges.select(F.col("b").alias("v"), F.col("a").alias("label"))
        seen = n


def connected_groups(links: DataFrame, a: str, b: str, *, least_gain: float = 0.02) -> DataFrame:
    """(vertex, group): every vertex with a link and the smallest vertex it reaches.

    Links are undirected; null ends and links of a vertex with itself are ignored,
    repeated links count once, other columns do not matter. No link gives an empty
    result. Vertices of degree one and two are taken out until they are fewer than ``least_gain`` of the links, as a round costs a
    pass over all links; the rest is the core, which is solved whatever its shape, so the result does not depend on it.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = spill(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    removed = []
    while n := edges.count():
        out = _reduce(edges, n, least_gain)
        if out is None:
            break
        discard(edges)
        removed.append(out[0])
        edges = out[1]
    core = edges.isEmpty()
    labels = [edges.select(F.col("a").alias("v"), F.col("b").alias("label")) if core else _star_contraction(edges)]
    for out in reversed(removed):
        known = labels[0]
        for part in labels[1:]:
            known = known.unionByName(part)
        known = known.select(F.col("v").alias("parent"), "label")
        labels.append(spill(out.join(known, "parent", "left").select("v", F.coalesce("label", "parent").alias("label")), "labels"))
    discard(*removed)
    every = labels[0]
    for part in labels[1:]:
        every = every.unionByName(part)
    lowest = spill(every.groupBy("label").agg(F.least(F.min("v"), F.first("label")).alias("group")), "groups")
    members = skewed_lookup(every, lowest, ["label"]).select(F.col("v").alias("vertex"), "group")
    return members.unionByName(lowest.select(F.col("label").alias("vertex"), "group"))
