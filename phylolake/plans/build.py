"""Building a release: raw tables in, canonical tables out, phase by phase and in part.

Every step is a function of DataFrames; :func:`build` strings them together and
writes through :meth:`Release.save`, so a phase can be run again on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylolake.api import Release
from phylolake.functions import hogid
from phylolake.operators import annotations, groups, homoeology, idmap, ontology, relations, similarity, summary, synteny
from phylolake.session import discard, spill
from phylolake.sinks import writers



def genome_offsets(genomes: DataFrame) -> DataFrame:
    """Genomes with ``entry_off``: entries of all genomes before them, in order of code."""
    w = Window.orderBy("species_code").rowsBetween(Window.unboundedPreceding, -1)
    return genomes.withColumn("entry_off", F.coalesce(F.sum("tot_entries").over(w), F.lit(0)))


def proteins(raw: DataFrame, genomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, sequence) from raw proteins (species_code, local_nr, seq, cdna, description, locus columns).

    Missing groups become 0 and '', sequences get their md5.
    """
    e = raw.join(genomes.select("species_code", "taxid", "entry_off"), "species_code").withColumn("entry_nr", F.col("entry_off") + F.col("local_nr"))
    texts = e.select("entry_nr", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("cdna", F.lit("")).alias("cdna"), F.coalesce("description", F.lit("")).alias("description"))
    entry = e.select(
        "entry_nr", "species_code", "taxid", F.coalesce("group_nr", F.lit(0)).cast("bigint").alias("group_nr"), F.coalesce("hog_id", F.lit("")).alias("hog_id"), hogid.family_nr("hog_id").alias("fam"),
        F.coalesce("chromosome", F.lit("")).alias("chromosome"), "locus_start", "locus_end", "strand", F.coalesce("alt_splice", F.lit(0)).alias("alt_splice"), F.lit("").alias("canonical_id"),
        F.md5(F.coalesce("seq", F.lit(""))).alias("md5"), F.coalesce("subgenome", F.lit("")).alias("subgenome"),
    )
    return entry, texts


def exon_length_problems(entry: DataFrame, exons: DataFrame, sequence: DataFrame) -> DataFrame:
    """Entries whose exons are not three times as long as the protein (stop codon allowed)."""
    total = exons.groupBy("entry_nr").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    extra = F.col("bases") - 3 * F.length("seq")
    return entry.select("entry_nr").join(total, "entry_nr").join(sequence.select("entry_nr", "seq"), "entry_nr").where(~extra.isin(0, 3)).select("entry_nr", "bases")


def typed_relations(pairs: DataFrame, entry: DataFrame) -> DataFrame:
    """Relations with their type inferred where it is unknown (n/a)."""
    g = entry.select("entry_nr", "species_code")
    j = pairs.join(g.toDF("entry_nr1", "s1"), "entry_nr1").join(g.toDF("entry_nr2", "s2"), "entry_nr2")
    inferred = relations.cardinality(j, "entry_nr1", "entry_nr2", ["s1"], ["s2"], "label")
    return inferred.withColumn("rel_type", F.when(F.col("rel_type") == 6, relations.type_code("label")).otherwise(F.col("rel_type"))).drop("s1", "s2", "label")


def homoeolog_scores(pairs: DataFrame, entry: DataFrame, genomes: DataFrame, *, window: int = 10) -> DataFrame:
    """Relations with local synteny and confidence of the homoeologs of polyploid genomes; -1 elsewhere."""
    poly = entry.join(genomes.where("polyploid = 1").select("species_code"), "species_code", "left_semi")
    mine = poly.select("entry_nr")
    h = pairs.where("rel_type = 5").join(mine.toDF("entry_nr1"), "entry_nr1", "left_semi").join(mine.toDF("entry_nr2"), "entry_nr2", "left_semi").drop("synteny", "confidence")
    scored = h.join(synteny.synteny_scores(h, poly, window=window), ["entry_nr1", "entry_nr2"], "left")
    conf = homoeology.homoeolog_confidence(relations.copy_number(scored)).select("entry_nr1", "entry_nr2", F.coalesce("synteny", F.lit(-1.0)).alias("synteny"), "confidence")
    keys = ["entry_nr1", "entry_nr2"]
    out = writers.replace_column(pairs, conf.select(*keys, "synteny"), keys, "synteny", -1.0)
    return writers.replace_column(out, conf.select(*keys, "confidence"), keys, "confidence", -1.0)


def group_metadata(entry: DataFrame, meta: DataFrame) -> DataFrame:
    """(group_nr, fingerprint, keywords, n_members) of every flat group; unknown texts are 'n/a' and ''."""
    n = groups.sizes(entry, "group_nr", 0).withColumnRenamed("n", "n_members")
    return n.join(meta.select("group_nr", "fingerprint", "keywords"), "group_nr", "left").select("group_nr", F.coalesce("fingerprint", F.lit("n/a")).alias("fingerprint"), F.coalesce("keywords", F.lit("")).alias("keywords"), "n_members")


def family_metadata(entry: DataFrame, keywords: DataFrame) -> DataFrame:
    """(fam, keywords, family_json) of every family, with all its members."""
    j = writers.family_json(entry).withColumnRenamed("json", "family_json")
    return j.join(keywords.select("fam", "keywords"), "fam", "left").select("fam", F.coalesce("keywords", F.lit("")).alias("keywords"), "family_json")


def missing_families(entry: DataFrame, meta: DataFrame) -> DataFrame:
    """Families without metadata; empty when a build is complete."""
    return writers.unfinished(entry.where("fam IS NOT NULL"), meta, "fam")


def summaries(entry: DataFrame, xref: DataFrame, go: DataFrame) -> dict[str, DataFrame]:
    """The small statistics tables of a release."""
    return {
        "group_sizes": groups.size_histogram(entry, "group_nr", 0), "family_sizes": groups.size_histogram(entry, "fam"), "evidence": annotations.evidence_summary(go, entry),
        "xrefs_per_source": xref.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "shared_groups": groups.shared_groups(entry, "group_nr", 0), "shared_families": groups.shared_groups(entry, "fam"),
        "genes_in_groups": groups.genes_in_groups(entry, "group_nr", 0), "importance": annotations.genome_importance(go, entry), "chromosomes": summary.chromosome_lengths(entry),
    }


def tree_profiles(levels: DataFrame, tree: DataFrame) -> DataFrame:
    """(fam, taxid, event): presence, loss and duplication of every family on every edge of the level tree.

    ``levels`` is (fam, hog_id, taxid), ``tree`` (taxid, parent_taxid). A family is present at a level with one of its
    groups, lost where the parent level has it and the level has not, duplicated where it has more groups than there.
    """
    n = levels.groupBy("fam", "taxid").agg(F.countDistinct("hog_id").alias("n"))
    present = n.select("fam", "taxid", F.lit("presence").alias("event"))
    edges = tree.select("taxid", "parent_taxid").join(levels.select("taxid").distinct(), "taxid", "left_semi")
    above = n.select("fam", F.col("taxid").alias("parent_taxid"), F.col("n").alias("n_above")).join(edges, "parent_taxid")
    j = above.join(n, ["fam", "taxid"], "left")
    lost = j.where("n IS NULL").select("fam", "taxid", F.lit("loss").alias("event"))
    dup = j.where("n > n_above").select("fam", "taxid", F.lit("duplication").alias("event"))
    return present.unionByName(lost).unionByName(dup)


def hog_forward_map(old: DataFrame, new: DataFrame, *, member: str = "canonical_id") -> DataFrame:
    """Forward map between the entries of two releases by the member identifiers of their groups."""
    return similarity.forward_map(similarity.member_sets(old, member), similarity.member_sets(new, member))


def build(release: Release, raw: dict[str, DataFrame], *, phases: tuple[str, ...] = ("proteins", "relations", "groups", "xrefs", "annotations", "caches")) -> None:
    """Write the canonical tables of a release from raw ones; ``phases`` may name a part to do again."""
    t = release.table
    if "proteins" in phases:
        release.save("genome", genome_offsets(raw["genome"]))
        release.save("taxonomy", raw["taxonomy"])
        entry, texts = proteins(raw["protein"], t("genome"))
        release.save("entry", entry)
        release.save("sequence", texts)
    if "relations" in phases:
        release.save("pairwise", homoeolog_scores(typed_relations(raw["pairwise"], t("entry")), t("entry"), t("genome")))
    if "groups" in phases:
        release.save("hog_level", groups.level_index(raw["hog_level"]))
        release.save("group_meta", group_metadata(t("entry"), raw["group_meta"]))
    if "xrefs" in phases:
        release.save("xref", raw["xref"])
        ranked = [idmap.SOURCES[s] for s in idmap.CANONICAL_ORDER]
        best = idmap.canonical(t("xref"), t("entry"), ranked)
        fresh = spill(writers.replace_column(t("entry"), best, ["entry_nr"], "canonical_id", ""), "entry")  # the table replaces itself
        release.save("entry", fresh)
        discard(fresh)
    if "annotations" in phases:
        release.save("go_term", raw["go_term"])
        release.save("go_edge", raw["go_edge"])
        release.save("go_annotation", annotations.without_obsolete(raw["go_annotation"], t("go_term")))
        freq = ontology.term_frequencies(t("go_annotation"), release.term_tree, t("go_term"))
        release.save("go_term_counts", freq.select("term_nr", "n"))
    if "caches" in phases:
        release.save("ortholog_counts", release.ortholog_counts())
