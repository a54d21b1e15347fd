"""Hierarchical and flat groups: members, sub-groups, levels, events, sizes, sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylolake.errors import UnknownLevel
from phylolake.functions import hogid


def members(entries: DataFrame, hog_id: str, clade: DataFrame | None = None) -> DataFrame:
    """Entries of a group and its sub-groups, optionally of the genomes (taxid) in ``clade`` only."""
    out = entries.where(hogid.within("hog_id", hog_id))
    return out if clade is None else out.join(clade.select("taxid").distinct(), "taxid", "left_semi")


def members_of_family(entries: DataFrame, fam: int) -> DataFrame:
    return entries.where(F.col("fam") == fam)


def members_at_level(entries: DataFrame, hogs: DataFrame, hog_id: str, level: str, clade: DataFrame) -> DataFrame:
    """Members of the group within a clade; the group has to be defined at that level."""
    if hogs.where((F.col("hog_id") == hog_id) & (F.col("level") == level)).isEmpty():
        raise UnknownLevel(f"{hog_id} is not defined at {level}")
    return members(entries, hog_id, clade)


def subhogs(hogs: DataFrame, hog_id: str, below: DataFrame, *, include_subids: bool = True, leaf_levels: DataFrame | None = None) -> DataFrame:
    """Group rows strictly below a level: ``below`` lists those levels; ``leaf_levels`` are dropped if given."""
    cond = hogid.within("hog_id", hog_id) if include_subids else F.col("hog_id") == hog_id
    out = hogs.where(cond).join(below.select("level").distinct(), "level", "left_semi")
    return out if leaf_levels is None else out.join(leaf_levels.select("level").distinct(), "level", "left_anti")


def hogs_at_level(hogs: DataFrame, hog_id: str, level: str) -> DataFrame:
    """Groups at a level that are ancestors or descendants of the given one (or itself)."""
    ancestor = F.lit(hog_id).startswith(F.concat(F.col("hog_id"), F.lit("."))) | (F.col("hog_id") == hog_id)
    return hogs.where((F.col("level") == level) & (ancestor | hogid.within("hog_id", hog_id)))


def root_row(hogs: DataFrame, hog_id: str, level: str | None = None) -> DataFrame:
    """The row of a group at a level, or at its root-most level."""
    own = hogs.where(F.col("hog_id") == hog_id)
    return own.where("is_root").limit(1) if level is None else own.where(F.col("level") == level).limit(1)


def parent_hogs(ids: DataFrame, hogs: DataFrame, lineage: DataFrame | None = None, *, hog_id: str = "hog_id") -> DataFrame:
    """(hog_id, parent_id, level): ancestors of every id, on levels of ``lineage`` (level, dist) if given.

    Ancestor ids are exploded, so the match is a hash join on the id.
    """
    own = ids.select(F.col(hog_id).alias("hog_id")).distinct()
    up = own.withColumn("parent_id", F.explode(hogid.ancestor_ids("hog_id")))
    out = up.join(hogs.select(F.col("hog_id").alias("parent_id"), "level"), "parent_id")
    return out.select("hog_id", "parent_id", "level") if lineage is None else out.join(lineage.select("level", "dist"), "level").select("hog_id", "parent_id", "level", "dist")


def compare_levels(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(hog_id, event): what became of the groups of a level at a level below.

    Same id: retained. A child below a parent id: duplicated. A parent without
    itself or a descendant among the children: lost. A child without an ancestor
    among the parents: gained. Both inputs have one row per hog_id.
    """
    p, c = parent.select("hog_id").distinct(), child.select("hog_id").distinct()
    up = c.select(F.col("hog_id").alias("child"), F.explode(hogid.ancestor_ids("hog_id")).alias("hog_id"))
    met = up.join(p, "hog_id")
    kept = met.where("child = hog_id").select(F.col("child").alias("hog_id"), F.lit("retained").alias("event"))
    split = met.where("child <> hog_id").select(F.col("child").alias("hog_id")).distinct().join(kept.select("hog_id"), "hog_id", "left_anti").withColumn("event", F.lit("duplicated"))
    lost = p.join(met.select("hog_id").distinct(), "hog_id", "left_anti").withColumn("event", F.lit("lost"))
    gained = c.join(met.select(F.col("child").alias("hog_id")).distinct(), "hog_id", "left_anti").withColumn("event", F.lit("gained"))
    return kept.unionByName(split).unionByName(lost).unionByName(gained)


def duplication_events(parent: DataFrame, child: DataFrame) -> int:
    """Number of parent groups that duplicated on the way to the child level."""
    p = parent.select("hog_id").distinct()
    c = child.select("hog_id").distinct()
    met = c.select(F.col("hog_id").alias("child"), F.explode(hogid.ancestor_ids("hog_id")).alias("hog_id")).join(p, "hog_id")
    return met.where("child <> hog_id").join(met.where("child = hog_id").select("child"), "child", "left_anti").select("hog_id").distinct().count()


def closest_level(hogs: DataFrame, tree_closure: DataFrame, level_taxid: int, *, taxid: str = "level_taxid") -> DataFrame:
    """Per family its groups at the wanted level, else at the closest level below it.

    ``hogs`` has (fam, hog_id, level_taxid).
    """
    below = tree_closure.where(F.col("ancestor") == level_taxid).select(F.col("descendant").alias(taxid), "dist")
    j = hogs.join(below, taxid)
    w = Window.partitionBy("fam")
    near = j.withColumn("__min", F.min("dist").over(w)).where("dist = __min")
    first = F.min(taxid).over(w)
    return near.withColumn("__t", first).where(F.col(taxid) == F.col("__t")).drop("__min", "__t")


def sizes(entries: DataFrame, key: str, none=None) -> DataFrame:
    """(key, n) of the groups, without null and the value that means none."""
    out = entries.where(F.col(key).isNotNull())
    out = out if none is None else out.where(F.col(key) != none)
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def size_histogram(entries: DataFrame, key: str, none=None) -> DataFrame:
    """(size, n_groups): two-level aggregation."""
    return sizes(entries, key, none).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("n_groups"))


def rollup_sizes(entries: DataFrame, hog_id: str = "hog_id") -> DataFrame:
    """(hog_id, n): members of every group, each member counted for its id and all ancestor ids."""
    return entries.select(F.explode(hogid.ancestor_ids(hog_id)).alias("hog_id")).groupBy("hog_id").agg(F.count(F.lit(1)).alias("n"))


def mode_group(entries: DataFrame, *, hog_id: str = "hog_id", group: str = "group_nr") -> DataFrame:
    """(hog_id, group_nr, n): the most frequent flat group among the members of every (sub-)group; ties go to the smaller number."""
    counts = entries.where(F.col(group) != 0).select(F.explode(hogid.ancestor_ids(hog_id)).alias("hog_id"), F.col(group).alias("group_nr")).groupBy("hog_id", "group_nr").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("hog_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "group_nr")).alias("b"))
    return best.select("hog_id", "b.group_nr", (-F.col("b.m")).alias("n"))


def shared_groups(entries: DataFrame, key: str, none=None, genome: str = "species_code") -> DataFrame:
    """(genome1, genome2, n): number of groups with members of both genomes; genome1 <= genome2.

    A group is first reduced to its genomes, so the pairs per group are bounded by
    the square of the number of genomes, not of the members.
    """
    g = entries.where(F.col(key).isNotNull() & (F.lit(True) if none is None else F.col(key) != none)).select(F.col(key).alias("k"), F.col(genome).alias("g")).distinct()
    a, b = g.withColumnRenamed("g", "genome1"), g.withColumnRenamed("g", "genome2")
    return a.join(b, "k").where("genome1 <= genome2").groupBy("genome1", "genome2").agg(F.count(F.lit(1)).alias("n"))


def genes_in_groups(entries: DataFrame, key: str, none=None, genome: str = "species_code") -> DataFrame:
    g = entries.where(F.col(key).isNotNull() & (F.lit(True) if none is None else F.col(key) != none))
    return g.groupBy(F.col(genome).alias("genome")).agg(F.count(F.lit(1)).alias("n"))


def most_similar_genomes(shared: DataFrame, genome: str, limit: int, *, least: bool = False) -> DataFrame:
    """The ``limit`` genomes sharing most (or fewest) groups with one; the genome itself is left out."""
    other = F.when(F.col("genome1") == genome, F.col("genome2")).otherwise(F.col("genome1"))
    mine = shared.where(((F.col("genome1") == genome) | (F.col("genome2") == genome)) & (F.col("genome1") != F.col("genome2")))
    return mine.select(other.alias("genome"), "n").orderBy(F.asc("n") if least else F.desc("n"), "genome").limit(limit)


def level_index(hogs: DataFrame) -> DataFrame:
    """Dense 0-based position of every group within its level, in order of ids."""
    return hogs.withColumn("idx_per_level", F.row_number().over(Window.partitionBy("level").orderBy("hog_id")) - 1)


def family_ranges(hogs: DataFrame) -> DataFrame:
    """(fam, start, stop): row range of every family when the table is sorted by family and id.

    Only row counts per family go through the global order, not the rows.
    """
    per = hogs.groupBy("fam").agg(F.count(F.lit(1)).alias("n"))
    stop = F.sum("n").over(Window.orderBy("fam").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("fam", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def top_groups(entries: DataFrame, hits: DataFrame, *, group: str = "group_nr", none=0, k: int = 10) -> DataFrame:
    """(group, n): the ``k`` groups with most entries among the hits (column entry_nr) of a search; ties go to the smaller group."""
    found = entries.where(F.col(group).isNotNull() & (F.col(group) != none)).join(hits.select("entry_nr").distinct(), "entry_nr", "left_semi")
    return found.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(k)
