"""Pairwise relations: lookups, induced orthologs and paralogs, cardinalities, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators.skew import salted_sides

# Relation types in the order of their codes.
REL_TYPES = ("1:1", "1:n", "m:1", "m:n", "close paralog", "homeolog", "n/a")


def type_label(col) -> Column:
    """Text of a relation type code; unknown codes are 'n/a'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in REL_TYPES]), c + 1), F.lit("n/a"))


def type_code(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    labels = F.create_map(*[x for i, t in enumerate(REL_TYPES) for x in (F.lit(t), F.lit(i))])
    return F.coalesce(F.try_element_at(labels, c), F.lit(len(REL_TYPES) - 1))


def reversed_label(col) -> Column:
    """Label of the same relation seen from the other end."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "1:n", "m:1").when(c == "m:1", "1:n").when(c == "n:1", "1:n").when(c == "1:m", "m:1").otherwise(c)


def is_main_isoform(alt: str = "alt_splice", nr: str = "entry_nr") -> Column:
    return (F.col(alt) == 0) | (F.col(alt) == F.col(nr))


def between_genomes(pairs: DataFrame, range1: tuple[int, int], range2: tuple[int, int]) -> DataFrame:
    """Relations from the entries of one genome to those of another (closed entry ranges)."""
    return pairs.where(F.col("entry_nr1").between(*range1) & F.col("entry_nr2").between(*range2))


def of_entry(pairs: DataFrame, entry_nr: int, types: list[int] | None = None) -> DataFrame:
    out = pairs.where(F.col("entry_nr1") == entry_nr)
    return out if types is None else out.where(F.col("rel_type").isin(types))


def cardinality(pairs: DataFrame, left: str, right: str, left_by: list[str], right_by: list[str], name: str = "rel_label") -> DataFrame:
    """'1:1', '1:n', 'm:1' or 'm:n' per pair.

    The left side is 'm' if ``right`` occurs in several pairs within ``left_by``
    (the genome of the left entry), the right side 'n' if ``left`` does within
    ``right_by``.
    """
    n_left = F.count(F.lit(1)).over(Window.partitionBy(right, *left_by))
    n_right = F.count(F.lit(1)).over(Window.partitionBy(left, *right_by))
    return pairs.withColumn(name, F.concat(F.when(n_left > 1, "m").otherwise("1"), F.lit(":"), F.when(n_right > 1, "n").otherwise("1")))


def _suffixed(df: DataFrame, i: int, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}{i}") for c in df.columns if c not in keep])


def induced_pairs(entries: DataFrame, *, same_genome: bool = False, orthologs: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of family members whose ids stand for a speciation (or, ``orthologs=False``, a duplication).

    ``entries`` has (entry_nr, fam, hog_id, species_code, group_nr). Pairs are between genomes
    with species_code1 < species_code2, or within one genome with entry_nr1 < entry_nr2; for orthologs
    the columns in ``also`` come along for both ends.

    Orthologs are most pairs of a family: the join on the root id is salted for large families,
    and ids that differ in the number of their first step, or have none, need no
    further comparison. Paralogs are few: they meet on the shared prefix and number
    of the step whose letters differ, never in a whole family; that join is salted as well.
    """
    t = hogid.tokens("hog_id")
    e = entries.where("fam IS NOT NULL AND hog_id <> ''").select("entry_nr", "fam", "hog_id", "species_code", "group_nr", t[0].alias("root"), *also)
    apart = (F.col("species_code1") == F.col("species_code2")) & (F.col("entry_nr1") < F.col("entry_nr2")) if same_genome else F.col("species_code1") < F.col("species_code2")
    if orthologs:
        first = F.regexp_extract(F.coalesce(F.try_element_at(t, F.lit(2)), F.lit("")), r"^([0-9]+)", 1).try_cast("bigint")
        left, right = salted_sides(e.withColumn("step", first), ["fam", "root"])
        keep = ["fam", "root", "__salt"]
        pairs = _suffixed(left, 1, keep).join(_suffixed(right, 2, keep), keep)
        quick = F.col("step1").isNull() | F.col("step2").isNull() | (F.col("step1") != F.col("step2"))
        test = F.when(quick, F.lit(True)).otherwise(hogid.are_orthologous("hog_id1", "hog_id2"))
        return pairs.where(apart & test).drop("root", "__salt", "step1", "step2")
    steps = e.withColumn("t", t).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("t")))).where("i > 1")
    token = F.element_at("t", F.col("i"))
    at = F.concat_ws(".", F.array_join(F.slice("t", F.lit(1), F.col("i") - 1), "."), F.regexp_extract(token, r"^([0-9]+)", 1))
    keyed = steps.select("fam", "entry_nr", "hog_id", "species_code", "group_nr", at.alias("at"), token.alias("token"))
    left, right = salted_sides(keyed, ["fam", "at"])
    keep = ["fam", "at", "__salt"]
    pairs = _suffixed(left, 1, keep).join(_suffixed(right, 2, keep), keep)
    return pairs.where(apart & (F.col("token1") != F.col("token2"))).drop("at", "__salt", "token1", "token2")


def induced_orthologs(entries: DataFrame) -> DataFrame:
    """Induced pairs between genomes with their cardinality and the flat group both share (null: none).

    The partners of an end within the other end's genome are the family members there
    minus the paralogs among them. Both are known per entry before the pairs are made, so
    the cardinality needs no further pass over the pairs.
    """
    root = hogid.tokens("hog_id")[0]
    e = entries.where("fam IS NOT NULL AND hog_id <> ''").withColumn("__root", root)
    own = e.groupBy("__root", "species_code").agg(F.count(F.lit(1)).alias("n_own"))
    para = induced_pairs(entries, orthologs=False).select("entry_nr1", "entry_nr2", "species_code1", "species_code2")
    both = para.select(F.col("entry_nr1").alias("entry_nr"), F.col("species_code2").alias("s")).unionByName(para.select(F.col("entry_nr2").alias("entry_nr"), F.col("species_code1").alias("s")))
    maps = both.groupBy("entry_nr", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("entry_nr").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("paralogs"))
    known = e.join(own, ["__root", "species_code"]).join(maps, "entry_nr", "left")
    pairs = induced_pairs(known, also=("n_own", "paralogs"))
    n_left = F.col("n_own1") - F.coalesce(F.try_element_at("paralogs2", F.col("species_code1")), F.lit(0))
    n_right = F.col("n_own2") - F.coalesce(F.try_element_at("paralogs1", F.col("species_code2")), F.lit(0))
    label = F.concat(F.when(n_left > 1, "m").otherwise("1"), F.lit(":"), F.when(n_right > 1, "n").otherwise("1"))
    shared = F.when((F.col("group_nr1") == F.col("group_nr2")) & (F.col("group_nr1") != 0), F.col("group_nr1"))
    return pairs.select("entry_nr1", "entry_nr2", "species_code1", "species_code2", "fam", label.alias("rel_label"), shared.alias("shared_group"))


def induced_paralogs(entries: DataFrame, levels: DataFrame, tree_closure: DataFrame, *, taxid: str = "taxid", same_genome: bool = False) -> DataFrame:
    """Duplicated pairs with the level their lineages diverged at, seen from the first entry.

    ``levels`` has (hog_id, level_taxid): where each id is defined. The divergence level lies one
    step towards the leaf from the most leaf-ward level of the first genome's lineage at which
    the common id exists; the leaf itself if that level is the leaf.
    """
    e = entries.select("entry_nr", F.col(taxid).alias("taxid"))
    pairs = induced_pairs(entries, same_genome=same_genome, orthologs=False)
    pairs = pairs.withColumn("common_id", hogid.common_group("hog_id1", "hog_id2")).join(e.withColumnRenamed("entry_nr", "entry_nr1"), "entry_nr1")
    at = pairs.join(levels.select(F.col("hog_id").alias("common_id"), F.col("level_taxid").alias("ancestor")), "common_id")
    on_path = at.join(tree_closure.select(F.col("descendant").alias("taxid"), "ancestor", "dist"), ["taxid", "ancestor"])
    near = on_path.groupBy("entry_nr1", "entry_nr2", "taxid", "common_id").agg(F.min("dist").alias("d"))
    step = near.withColumn("dist", F.greatest(F.col("d") - 1, F.lit(0)))
    found = step.join(tree_closure.select(F.col("descendant").alias("taxid"), F.col("ancestor").alias("divergence_taxid"), "dist"), ["taxid", "dist"])
    return found.select("entry_nr1", "entry_nr2", "common_id", "divergence_taxid")


def _relatives(entries: DataFrame, by: list[str]) -> DataFrame:
    """(entry_nr, same, paralogs): family members and duplicated ones among them, within ``by``; itself not counted.

    Counted over the prefixes of the ids, never over pairs: the members whose first
    differing token has the same number are those below the shared prefix and
    number minus those below the whole token.
    """
    t = hogid.tokens("hog_id")
    steps = entries.select("entry_nr", *by, t.alias("t"), F.explode(F.sequence(F.lit(1), F.size(t))).alias("i"))
    token = F.element_at("t", F.col("i"))
    parts = steps.select(
        "entry_nr", *by, "i", F.array_join(F.slice("t", F.lit(1), F.col("i")), ".").alias("whole"),
        F.when(F.col("i") > 1, F.concat_ws(".", F.array_join(F.slice("t", F.lit(1), F.col("i") - 1), "."), F.regexp_extract(token, r"^([0-9]+)", 1))).alias("number"),
    )
    n_whole = parts.groupBy(*by, "whole").agg(F.count(F.lit(1)).alias("n_whole"))
    n_number = parts.where("number IS NOT NULL").groupBy(*by, "number").agg(F.count(F.lit(1)).alias("n_number"))
    counted = parts.join(n_whole, [*by, "whole"]).join(n_number, [*by, "number"], "left")
    return counted.groupBy("entry_nr").agg(
        (F.max(F.when(F.col("i") == 1, F.col("n_whole"))) - 1).alias("same"), F.coalesce(F.sum(F.col("n_number") - F.col("n_whole")), F.lit(0)).alias("paralogs")
    )


def ortholog_counts(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Partners per entry: pairwise, induced orthologs and paralogs, members of the flat group, any of the former three.

    Entries without any partner are listed with zeros; the entry itself is never
    counted. Family and group partners are counted over id prefixes, so no
    family is expanded into its pairs, however large; only the delivered pairs are
    tested one by one.
    """
    e = entries.select("entry_nr", "group_nr", F.when((F.col("hog_id") != "") & F.col("fam").isNotNull(), F.col("hog_id")).alias("hog_id"))
    family = e.where("hog_id IS NOT NULL")
    in_family = _relatives(family, []).select("entry_nr", (F.col("same") - F.col("paralogs")).alias("ho"), F.col("paralogs").alias("hp"))
    grouped = e.where("group_nr <> 0")
    both_ways = _relatives(grouped.where("hog_id IS NOT NULL"), ["group_nr"]).select("entry_nr", (F.col("same") - F.col("paralogs")).alias("gr_ho"))
    n_group = grouped.groupBy("group_nr").agg((F.count(F.lit(1)) - 1).alias("gr"))
    in_group = grouped.join(n_group, "group_nr").select("entry_nr", "gr")
    p = pairs.select("entry_nr1", "entry_nr2").unionByName(pairs.select(F.col("entry_nr2").alias("entry_nr1"), F.col("entry_nr1").alias("entry_nr2"))).distinct()
    ids = [e.select(*[F.col(c).alias(f"{c}{i}") for c in ("entry_nr", "group_nr", "hog_id")]) for i in (1, 2)]
    known = p.join(ids[0], "entry_nr1", "left").join(ids[1], "entry_nr2", "left")
    elsewhere = F.coalesce(hogid.are_orthologous("hog_id1", "hog_id2"), F.lit(False)) | F.coalesce((F.col("group_nr1") == F.col("group_nr2")) & (F.col("group_nr1") != 0), F.lit(False))
    direct = known.groupBy(F.col("entry_nr1").alias("entry_nr")).agg(F.count(F.lit(1)).alias("vp"), F.sum(F.when(elsewhere, 0).otherwise(1)).alias("vp_only"))
    out = entries.select("entry_nr")
    for part in (direct, in_family, in_group, both_ways):
        out = out.join(part, "entry_nr", "left")
    out = out.na.fill(0)
    any_ = F.col("ho") + (F.col("gr") - F.col("gr_ho")) + F.col("vp_only")
    named = {"n_pairwise": F.col("vp"), "n_induced_orthologs": F.col("ho"), "n_induced_paralogs": F.col("hp"), "n_group": F.col("gr"), "n_any": any_}
    return out.select("entry_nr", *[c.cast("bigint").alias(n) for n, c in named.items()])


def copy_number(pairs: DataFrame) -> DataFrame:
    """Pairs with the number of partners of both ends added up."""
    n1 = F.count(F.lit(1)).over(Window.partitionBy("entry_nr1"))
    n2 = F.count(F.lit(1)).over(Window.partitionBy("entry_nr2"))
    return pairs.withColumn("copy_nr", n1 + n2)


def relation_counts(pairs: DataFrame) -> DataFrame:
    """Number of relations per entry and type label."""
    return pairs.groupBy(F.col("entry_nr1").alias("entry_nr"), type_label("rel_type").alias("rel_label")).agg(F.count(F.lit(1)).alias("n"))


def genome_pairs(genomes: DataFrame, genome: str = "species_code") -> DataFrame:
    """(genome1, genome2): all pairs of genomes, each once. A dimension of a few thousand genomes; the pairs come from one array of
    their names per genome, without a cross join."""
    names = genomes.select(genome).where(F.col(genome).isNotNull()).distinct()
    every = names.groupBy().agg(F.array_sort(F.collect_set(genome)).alias("g"))
    first = every.select("g", F.explode("g").alias("genome1"))
    return first.select("genome1", F.explode(F.filter("g", lambda x: x > F.col("genome1"))).alias("genome2"))


def pair_export(pairs: DataFrame, entries: DataFrame, genomes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(genome1, genome2, entry_nr1, entry_nr2, rel_label, id1, id2): the relations of every pair of genomes, for one file per pair.

    ``ids`` (entry_nr, id) has at most one id per entry; entries without one keep a null. A pair of genomes is known by its two
    genomes and their order, so the table of all pairs of genomes is never made.
    """
    e = entries.select("entry_nr", "species_code").join(genomes.select("species_code").distinct(), "species_code", "left_semi").select("entry_nr", "species_code")
    j = pairs.join(e.toDF("entry_nr1", "genome1"), "entry_nr1").join(e.toDF("entry_nr2", "genome2"), "entry_nr2").where("genome1 < genome2")
    out = j.select("genome1", "genome2", "entry_nr1", "entry_nr2", type_label("rel_type").alias("rel_label"))
    if ids is None:
        return out.withColumn("id1", F.lit(None).cast("string")).withColumn("id2", F.lit(None).cast("string"))
    return out.join(ids.toDF("entry_nr1", "id1"), "entry_nr1", "left").join(ids.toDF("entry_nr2", "id2"), "entry_nr2", "left").select(*out.columns, "id1", "id2")


def induced_cardinality(entries: DataFrame, entry_nr: int) -> DataFrame:
    """(entry_nr, species_code, rel_label): induced orthologs of one entry with their cardinality.

    'm' if the partner has several orthologs in the entry's genome, 'n' if the entry has several in the partner's.
    """
    e = entries.where("fam IS NOT NULL AND hog_id <> ''").select("entry_nr", "fam", "hog_id", "species_code")
    q = e.where(F.col("entry_nr") == entry_nr).select("fam", F.col("hog_id").alias("q"), F.col("species_code").alias("own"))
    fam = e.join(F.broadcast(q.limit(1)), "fam")
    partners = fam.where((F.col("species_code") != F.col("own")) & hogid.are_orthologous("q", "hog_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("species_code"))
    mine = fam.where(F.col("species_code") == F.col("own")).groupBy("fam", F.col("hog_id").alias("h")).agg(F.count(F.lit(1)).alias("genes"))
    related = partners.select("fam", "hog_id").distinct().join(mine, "fam").where(hogid.are_orthologous("h", "hog_id"))
    left = related.groupBy("hog_id").agg(F.sum("genes").alias("left"))
    label = F.concat(F.when(F.col("left") > 1, "m").otherwise("1"), F.lit(":"), F.when(n > 1, "n").otherwise("1"))
    return partners.join(left, "hog_id").select("entry_nr", "species_code", label.alias("rel_label"))
