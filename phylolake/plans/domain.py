"""Views of a release for the registered queries, as DataFrames and as SQL.

The raw tables are dirty (repeated deliveries, sentinels, missing references); the
views hold the newest release with one row per key and plain missing values.
Taxonomy and ontology edges are not delivered with the tables: they are derived by
rule, a binary heap over the levels and over the terms, with the genomes as leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import hierarchy
from phylolake.operators.joins import interval_join
from phylolake.operators.snapshots import latest_delivery
from phylolake.session import once, table

VIEWS: dict[str, str] = {
    "genome_v": """SELECT UniProtSpeciesCode AS species_code, min(NCBITaxonId) AS taxid, min(EntryOff) AS entry_off, min(TotEntries) AS tot_entries,
        max(coalesce(SciName, '')) AS sci_name, max(CASE WHEN IsPolyploid THEN 1 ELSE 0 END) AS polyploid FROM genome WHERE UniProtSpeciesCode IS NOT NULL GROUP BY 1""",
    "entry_r": """SELECT EntryNr AS entry_nr, coalesce(OmaGroup, 0) AS group_nr,
        regexp_replace(trim(coalesce(OmaHOG, '')), '_-?[0-9]+$', '') AS hog_raw, coalesce(Chromosome, '') AS chromosome,
        coalesce(LocusStart, 0) AS locus_start, coalesce(LocusEnd, 0) AS locus_end, coalesce(LocusStrand, 0) AS strand, coalesce(AltSpliceVariant, 0) AS alt_splice,
        coalesce(CanonicalId, '') AS canonical_id, coalesce(MD5ProteinHash, '') AS md5, coalesce(SubGenome, '') AS subgenome,
        row_number() OVER (PARTITION BY EntryNr ORDER BY DeliveredAt DESC NULLS LAST, coalesce(OmaGroup, 0) DESC, coalesce(OmaHOG, '') DESC, coalesce(Chromosome, '') DESC,
          coalesce(LocusStart, 0) DESC, coalesce(LocusEnd, 0) DESC, coalesce(LocusStrand, 0) DESC, coalesce(AltSpliceVariant, 0) DESC, coalesce(CanonicalId, '') DESC,
          coalesce(MD5ProteinHash, '') DESC, coalesce(SubGenome, '') DESC) AS rn FROM entry WHERE ReleaseNr = (SELECT max(ReleaseNr) FROM entry)""",
    "entry_v": """SELECT e.* EXCLUDE (rn, hog_raw), CASE WHEN hog_raw LIKE 'HOG:E%' THEN 'HOG:E' || lpad(ltrim(regexp_extract(hog_raw, '^HOG:E([0-9]+)', 1), '0'), 7, '0')
          || regexp_replace(hog_raw, '^HOG:E[0-9]+', '') ELSE '' END AS hog_id,
        try_cast(nullif(regexp_extract(hog_raw, '^HOG:[A-Za-z]*0*([0-9]+)', 1), '') AS BIGINT) AS fam, g.species_code, g.taxid
        FROM entry_r e JOIN genome_v g ON e.entry_nr > g.entry_off AND e.entry_nr <= g.entry_off + g.tot_entries WHERE rn = 1""",
    "main_v": "SELECT * FROM entry_v WHERE alt_splice = 0 OR alt_splice = entry_nr",
    "hog_v": """SELECT DISTINCT Fam AS fam, ID AS hog_id, Level AS level, max(IsRoot) OVER (PARTITION BY ID, Level) AS is_root,
        max(coalesce(NrMemberGenes, 0)) OVER (PARTITION BY ID, Level) AS nr_members,
        max(CASE WHEN isnan(CompletenessScore) OR CompletenessScore IS NULL THEN -1 ELSE round(CompletenessScore::DOUBLE * 10000) / 10000 END) OVER (PARTITION BY ID, Level) AS completeness
        FROM hog_level WHERE Level IS NOT NULL""",
    "pair_v": """SELECT EntryNr1 AS entry_nr1, EntryNr2 AS entry_nr2, min(RelType) AS rel_type, max(round(coalesce(Score, -1)::DOUBLE, 3)) AS score
        FROM pairwise WHERE EntryNr1 <> 0 AND EntryNr2 <> 0 AND EntryNr1 <> EntryNr2 AND RelType IS NOT NULL GROUP BY 1, 2""",
    "level_v": "SELECT level, row_number() OVER (ORDER BY level) AS rn FROM (SELECT DISTINCT Level AS level FROM hog_level WHERE Level IS NOT NULL)",
    "tax_v": """SELECT CAST(rn AS BIGINT) AS taxid, CAST(rn // 2 AS BIGINT) AS parent_taxid, level AS name FROM level_v
        UNION ALL SELECT CAST(taxid AS BIGINT), CAST(1 + taxid % (SELECT count(*) FROM level_v) AS BIGINT), species_code FROM genome_v""",
    "tax_closure": """SELECT taxid AS descendant, taxid AS ancestor, 0::BIGINT AS dist FROM tax_v
        UNION ALL SELECT c.descendant, t.parent_taxid, c.dist + 1 FROM tax_closure c JOIN tax_v t ON t.taxid = c.ancestor WHERE t.parent_taxid <> 0""",
    "term_v": "SELECT TermNr AS term_nr, max(coalesce(Aspect, '')) AS aspect, max(coalesce(Name, '')) AS name FROM go_term WHERE TermNr IS NOT NULL AND ObsoleteIn IS NULL GROUP BY 1",
    "term_n": "SELECT term_nr, row_number() OVER (ORDER BY term_nr) AS rn FROM term_v",
    "go_edge": """SELECT DISTINCT a.term_nr AS child, b.term_nr AS parent FROM term_n a JOIN term_n b
        ON b.rn = a.rn // 2 OR (a.rn % 3 = 0 AND a.rn >= 6 AND b.rn = a.rn // 3)""",
    "go_paths": """SELECT child AS descendant, parent AS ancestor, 1::BIGINT AS dist FROM go_edge
        UNION ALL SELECT c.descendant, e.parent, c.dist + 1 FROM go_paths c JOIN go_edge e ON e.child = c.ancestor""",
    "go_closure": """SELECT descendant, ancestor, min(dist) AS dist FROM (SELECT * FROM go_paths UNION ALL SELECT term_nr, term_nr, 0 FROM term_v) GROUP BY 1, 2""",
    "go_v": """SELECT DISTINCT EntryNr AS entry_nr, TermNr AS term_nr, upper(trim(coalesce(Evidence, ''))) AS evidence, coalesce(Reference, '') AS reference
        FROM go_annotation WHERE ReleaseNr = (SELECT max(ReleaseNr) FROM entry) AND EntryNr <> 0 AND TermNr <> 0""",
    "xref_v": """SELECT DISTINCT EntryNr AS entry_nr, XRefSource AS source, trim(XRefId) AS xref_id, coalesce(Verification, 2) AS verification
        FROM xref WHERE ReleaseNr = (SELECT max(ReleaseNr) FROM entry) AND EntryNr <> 0 AND XRefSource IS NOT NULL AND trim(coalesce(XRefId, '')) <> ''""",
    "domain_v": """SELECT l_orderkey + 1 AS entry_nr, l_linenumber AS nr, 'PF' || lpad(CAST(l_partkey % 97 AS VARCHAR), 5, '0') AS domain_id,
        CAST(1 + (l_linenumber - 1) * 60 + l_suppkey % 7 AS BIGINT) AS dom_start, CAST(1 + (l_linenumber - 1) * 60 + l_suppkey % 7 + 10 + CAST(l_quantity AS BIGINT) % 40 AS BIGINT) AS dom_end FROM lineitem""",
    "seq_v": """SELECT doc_id AS seq_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWXY]', '', 'g') AS seq FROM documents""",
}


def releases(spark: SparkSession, sf: str) -> list[int]:
    """The delivered releases, oldest first; read anew for every query."""
    return sorted(r[0] for r in table(spark, sf, "entry").select("ReleaseNr").distinct().where("ReleaseNr IS NOT NULL").collect())


def newest(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "entry").agg(F.max("ReleaseNr")).first()[0] or 0


def genome(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "genome").where("UniProtSpeciesCode IS NOT NULL")
    return g.groupBy(F.col("UniProtSpeciesCode").alias("species_code")).agg(
        F.min("NCBITaxonId").alias("taxid"), F.min("EntryOff").alias("entry_off"), F.min("TotEntries").alias("tot_entries"),
        F.max(F.coalesce("SciName", F.lit(""))).alias("sci_name"), F.max(F.when(F.col("IsPolyploid"), 1).otherwise(0)).alias("polyploid"),
    )


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the newest release with group ids in plain spelling, family and genome; written once per session and release."""
    return once(spark, f"entry {newest(spark, sf)} {sf}", lambda: _entry(spark, sf))


def _entry(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entry").where(F.col("ReleaseNr") == newest(spark, sf))
    last = latest_delivery(e, ["EntryNr"], "DeliveredAt", {
        "group_nr": F.coalesce("OmaGroup", F.lit(0)), "hog_raw": F.coalesce("OmaHOG", F.lit("")), "chromosome": F.coalesce("Chromosome", F.lit("")),
        "locus_start": F.coalesce("LocusStart", F.lit(0)), "locus_end": F.coalesce("LocusEnd", F.lit(0)), "strand": F.coalesce("LocusStrand", F.lit(0)),
        "alt_splice": F.coalesce("AltSpliceVariant", F.lit(0)), "canonical_id": F.coalesce("CanonicalId", F.lit("")), "md5": F.coalesce("MD5ProteinHash", F.lit("")),
        "subgenome": F.coalesce("SubGenome", F.lit("")),
    })
    fam = hogid.family_nr("hog_raw")
    tail = F.regexp_replace(hogid.plain_id("hog_raw"), r"^HOG:[A-Za-z]*[0-9]+", "")
    padded = F.when(F.col("hog_raw").contains("HOG:E"), F.concat(hogid.format_id(fam, "E"), tail)).otherwise(F.lit(""))
    plain = last.withColumn("hog_id", padded).withColumn("fam", fam).withColumnRenamed("EntryNr", "entry_nr").drop("hog_raw")
    g = genome(spark, sf).select("species_code", "taxid", "entry_off", "tot_entries")
    joined = interval_join(plain, g, "entry_nr", F.col("entry_off") + 1, F.col("entry_off") + F.col("tot_entries"), width=4096)
    return joined.drop("entry_off", "tot_entries")


def main(spark: SparkSession, sf: str) -> DataFrame:
    return entry(spark, sf).where("alt_splice = 0 OR alt_splice = entry_nr")


def hog(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.isnan("CompletenessScore") | F.col("CompletenessScore").isNull(), -1.0).otherwise(F.round(F.col("CompletenessScore").cast("double") * 10000) / 10000)
    return (
        table(spark, sf, "hog_level").where("Level IS NOT NULL")
        .groupBy(F.col("Fam").alias("fam"), F.col("ID").alias("hog_id"), F.col("Level").alias("level"))
        .agg(F.max("IsRoot").alias("is_root"), F.max(F.coalesce("NrMemberGenes", F.lit(0))).alias("nr_members"), F.max(score).alias("completeness"))
    )


def pair(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pairwise").where("EntryNr1 <> 0 AND EntryNr2 <> 0 AND EntryNr1 <> EntryNr2 AND RelType IS NOT NULL")
    return p.groupBy(F.col("EntryNr1").alias("entry_nr1"), F.col("EntryNr2").alias("entry_nr2")).agg(
        F.min("RelType").alias("rel_type"), F.max(F.round(F.coalesce("Score", F.lit(-1)).cast("double"), 3)).alias("score")
    )


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """(level, rn) of the distinct level names; a dimension of a few thousand clades."""
    names = table(spark, sf, "hog_level").where("Level IS NOT NULL").select(F.col("Level").alias("level")).distinct()
    return names.withColumn("rn", F.row_number().over(Window.orderBy("level")))


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    lv = levels(spark, sf)
    n = lv.agg(F.count(F.lit(1)).alias("n"))
    clades = lv.select(F.col("rn").cast("bigint").alias("taxid"), F.floor(F.col("rn") / 2).cast("bigint").alias("parent_taxid"), F.col("level").alias("name"))
    leaves = genome(spark, sf).withColumn("n", F.lit(n.first()[0])).select(
        F.col("taxid").cast("bigint"), (1 + F.col("taxid") % F.col("n")).cast("bigint").alias("parent_taxid"), F.col("species_code").alias("name")
    )
    return clades.unionByName(leaves)


def term(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "go_term").where("TermNr IS NOT NULL AND ObsoleteIn IS NULL")
    return t.groupBy(F.col("TermNr").alias("term_nr")).agg(F.max(F.coalesce("Aspect", F.lit(""))).alias("aspect"), F.max(F.coalesce("Name", F.lit(""))).alias("name"))


def go_edge(spark: SparkSession, sf: str) -> DataFrame:
    n = term(spark, sf).select("term_nr", F.row_number().over(Window.orderBy("term_nr")).alias("rn"))
    up = F.array_distinct(F.filter(F.array(F.floor(F.col("rn") / 2), F.when((F.col("rn") % 3 == 0) & (F.col("rn") >= 6), F.floor(F.col("rn") / 3))), lambda x: x >= 1))
    children = n.select(F.col("term_nr").alias("child"), F.explode(up).alias("rn"))
    return children.join(n.withColumnRenamed("term_nr", "parent"), "rn").select("child", "parent").distinct()


def go(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "go_annotation").where(f"ReleaseNr = {newest(spark, sf)} AND EntryNr <> 0 AND TermNr <> 0")
    return a.select(
        F.col("EntryNr").alias("entry_nr"), F.col("TermNr").alias("term_nr"), F.upper(F.trim(F.coalesce("Evidence", F.lit("")))).alias("evidence"), F.coalesce("Reference", F.lit("")).alias("reference")
    ).distinct()


def xref(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "xref").where(f"ReleaseNr = {newest(spark, sf)} AND EntryNr <> 0 AND XRefSource IS NOT NULL AND trim(coalesce(XRefId, '')) <> ''")
    return x.select(
        F.col("EntryNr").alias("entry_nr"), F.col("XRefSource").alias("source"), F.trim("XRefId").alias("xref_id"), F.coalesce("Verification", F.lit(2)).alias("verification")
    ).distinct()


def go_tree(spark: SparkSession, sf: str) -> DataFrame:
    """(descendant, ancestor, dist) of the live terms, written once per session."""
    return once(spark, f"go_tree {sf}", lambda: hierarchy.closure(go_edge(spark, sf), "child", "parent", term(spark, sf), "term_nr"))


def tax_tree(spark: SparkSession, sf: str) -> DataFrame:
    """(descendant, ancestor, dist) of the clades and genomes, written once per session."""
    tax = taxonomy(spark, sf)
    return once(spark, f"tax_tree {sf}", lambda: hierarchy.closure(tax.where("parent_taxid <> 0"), "taxid", "parent_taxid", tax, "taxid"))


def domain(spark: SparkSession, sf: str) -> DataFrame:
    start = 1 + (F.col("l_linenumber") - 1) * 60 + F.col("l_suppkey") % 7
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("entry_nr"), F.col("l_linenumber").alias("nr"), F.format_string("PF%05d", F.col("l_partkey") % 97).alias("domain_id"),
        start.cast("bigint").alias("dom_start"), (start + 10 + F.col("l_quantity").cast("bigint") % 40).cast("bigint").alias("dom_end"),
    )


def sequence(spark: SparkSession, sf: str) -> DataFrame:
    from phylolake.functions.sequence import sanitise

    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), sanitise(letters).alias("seq"))
