"""Gene order: neighbourhoods, adjacency edges, ancestral propagation, synteny scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylolake.session import spill

# Evidence of an ancestral edge; a lower code is stronger.
EVIDENCE = {"linearized": 1, "parsimonious": 2, "any": 4}


def gene_order(entries: DataFrame, *, start: str = "locus_start") -> DataFrame:
    """Main isoforms with their position ``pos`` on the chromosome (from 1)."""
    w = Window.partitionBy("species_code", "chromosome").orderBy(start, "entry_nr")
    return entries.where("alt_splice = 0 OR alt_splice = entry_nr").withColumn("pos", F.row_number().over(w))


def neighbours(entries: DataFrame, queries: DataFrame, window: int = 1) -> DataFrame:
    """(query_nr, entry_nr, offset): up to ``window`` genes on either side of each query on its chromosome, itself at 0."""
    if window < 1:
        raise ValueError("the window has to be a positive number")
    g = gene_order(entries).select("entry_nr", "species_code", "chromosome", "pos")
    q = g.join(queries.select("entry_nr").distinct(), "entry_nr", "left_semi").withColumnRenamed("entry_nr", "query_nr")
    offsets = F.explode(F.sequence(F.lit(-window), F.lit(window)))
    wanted = q.select("query_nr", "species_code", "chromosome", F.col("pos").alias("p"), offsets.alias("offset")).withColumn("pos", F.col("p") + F.col("offset"))
    return wanted.join(g, ["species_code", "chromosome", "pos"]).select("query_nr", "entry_nr", "offset")


def adjacent_edges(entries: DataFrame, node: str = "entry_nr") -> DataFrame:
    """(species_code, node1, node2, weight): consecutive genes of a chromosome."""
    g = gene_order(entries)
    w = Window.partitionBy("species_code", "chromosome").orderBy("pos")
    out = g.withColumn("node2", F.lead(node).over(w)).where("node2 IS NOT NULL")
    return out.select("species_code", F.col(node).alias("node1"), "node2", F.lit(1).alias("weight"))


def order_window(entries: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """(query_nr, entry_nr): genes within half a window in genome order that lie on the query's chromosome."""
    w = Window.partitionBy("species_code").orderBy("chromosome", "locus_start", "entry_nr")
    g = entries.where("alt_splice = 0 OR alt_splice = entry_nr").withColumn("pos", F.row_number().over(w)).select("entry_nr", "species_code", "chromosome", "pos")
    q = g.join(queries.select("entry_nr").distinct(), "entry_nr", "left_semi")
    spread = q.select(F.col("entry_nr").alias("query_nr"), "species_code", "chromosome", F.explode(F.sequence(F.col("pos") - size // 2, F.col("pos") + size // 2)).alias("pos"))
    return spread.join(g, ["species_code", "chromosome", "pos"]).select("query_nr", "entry_nr")


def synteny_scores(pairs: DataFrame, entries: DataFrame, *, window: int = 10) -> DataFrame:
    """(entry_nr1, entry_nr2, synteny): share of related genes in the windows around both ends of each pair.

    (distinct related genes - 1) / (window genes - 1) of both sides, averaged; pairs with a
    window of a single gene have no score. Related means connected by one of ``pairs``.
    """
    p = pairs.select("entry_nr1", "entry_nr2").distinct()
    ends = p.select(F.col("entry_nr1").alias("entry_nr")).unionByName(p.select(F.col("entry_nr2").alias("entry_nr"))).distinct()
    near = order_window(entries, ends, window)
    size = near.groupBy(F.col("query_nr").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    left = p.join(near.select(F.col("query_nr").alias("entry_nr1"), F.col("entry_nr").alias("x")), "entry_nr1")
    both = p.select(F.col("entry_nr1").alias("x"), F.col("entry_nr2").alias("y"))
    rel = left.join(both, "x").join(near.select(F.col("query_nr").alias("entry_nr2"), F.col("entry_nr").alias("y")), ["entry_nr2", "y"])
    hits = rel.groupBy("entry_nr1", "entry_nr2").agg(F.countDistinct("x").alias("h1"), F.countDistinct("y").alias("h2"))
    sized = hits.join(size.toDF("entry_nr1", "n1"), "entry_nr1").join(size.toDF("entry_nr2", "n2"), "entry_nr2").where("n1 > 1 AND n2 > 1")
    return sized.select("entry_nr1", "entry_nr2", (((F.col("h1") - 1) / (F.col("n1") - 1) + (F.col("h2") - 1) / (F.col("n2") - 1)) / 2).alias("synteny"))


def evidence_filter(edges: DataFrame, evidence: str = "parsimonious") -> DataFrame:
    return edges.where(F.col("evidence") <= EVIDENCE[evidence])


def neighbourhood(edges: DataFrame, centre: DataFrame, steps: int, *, a: str = "node1", b: str = "node2") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``steps`` of the centre nodes (column node); the subgraph has all edges among its nodes."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    reached = centre.select("node").distinct().withColumn("dist", F.lit(0))
    front = reached.select("node")
    for step in range(1, steps + 1):
        front = both.join(front.withColumnRenamed("node", "x"), "x", "left_semi").select(F.col("y").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        reached = reached.unionByName(front.withColumn("dist", F.lit(step)))
        if step % 4 == 0:
            reached, front = spill(reached, "reached"), spill(front, "front")
    inside = reached.select("node")
    sub = edges.join(inside.withColumnRenamed("node", a), a, "left_semi").join(inside.withColumnRenamed("node", b), b, "left_semi")
    return reached, sub


def direct_neighbours(edges: DataFrame, node, *, a: str = "node1", b: str = "node2") -> DataFrame:
    """(node, weight) of the nodes one edge away."""
    return edges.where((F.col(a) == node) | (F.col(b) == node)).select(F.when(F.col(a) == node, F.col(b)).otherwise(F.col(a)).alias("node"), "weight")


def lift_edges(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges of the children of a clade lifted to the parent groups, weights added up.

    ``edges`` is (node1, node2, weight), ``parents`` (node, parent). Edges whose ends have no parent,
    or the same one, vanish; the smaller id comes first.
    """
    p = parents.select("node", "parent")
    j = edges.join(p.toDF("node1", "p1"), "node1").join(p.toDF("node2", "p2"), "node2").where("p1 <> p2")
    return j.groupBy(F.least("p1", "p2").alias("node1"), F.greatest("p1", "p2").alias("node2")).agg(F.sum("weight").alias("weight"))


def propagate_edges(leaf_edges: DataFrame, parents_by_depth: list[DataFrame]) -> DataFrame:
    """(depth, node1, node2, weight): edges at every level, from the leaves (highest depth) to the root (0).

    ``parents_by_depth[d]`` maps the nodes of depth d+1 to their parents of depth d.
    """
    level = leaf_edges.select("node1", "node2", "weight")
    out = level.withColumn("depth", F.lit(len(parents_by_depth)))
    for d in range(len(parents_by_depth) - 1, -1, -1):
        level = spill(lift_edges(level, parents_by_depth[d]), "lifted")
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out.select("depth", "node1", "node2", "weight")


def edges_to_rows(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges between group ids as edges between row numbers (rows: hog_id, row_nr); ids without a row are dropped."""
    plain = lambda c: F.substring_index(c, "_", 1)
    r = rows.select("hog_id", "row_nr")
    j = edges.withColumn("h1", plain("node1")).withColumn("h2", plain("node2")).join(r.toDF("h1", "row1"), "h1").join(r.toDF("h2", "row2"), "h2")
    return j.select("row1", "row2", "weight")
