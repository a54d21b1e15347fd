"""Annotation lookups, exports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylolake.operators.ontology import EXPERIMENTAL, HIGH_THROUGHPUT, aspect_letter, term_id


def entries_with(annotations: DataFrame, column: str, value, *, evidence: str | None = None, allowed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct entries annotated with a term (GO, EC or domain), among ``allowed`` if given.

    Without ``limit`` the result is complete; with it, the smallest entry numbers come first.
    """
    out = annotations.where(F.col(column) == value)
    if evidence is not None:
        out = out.where(F.col("evidence") == evidence)
    if allowed is not None:
        out = out.join(allowed.select("entry_nr").distinct(), "entry_nr", "left_semi")
    out = out.select("entry_nr").distinct()
    return out if limit is None else out.orderBy("entry_nr").limit(limit)


def annotation_count(annotations: DataFrame, column: str, value) -> int:
    """Number of annotation rows (not entries) of a term."""
    return annotations.where(F.col(column) == value).count()


def of_range(annotations: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Annotations of one entry, or of the half-open range [start, stop)."""
    nr = F.col("entry_nr")
    return annotations.where((nr == start) if stop is None else ((nr >= start) & (nr < stop)))


def without_obsolete(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    return annotations.join(terms.select("term_nr"), "term_nr", "left_semi")


def filter_entries(df: DataFrame, allowed: DataFrame, nr: str = "entry_nr") -> DataFrame:
    """Rows of the allowed entries: the range of their numbers is pushed to the scan, the set is the residual."""
    low, high = allowed.agg(F.min(nr), F.max(nr)).first()
    if low is None:
        return df.where(F.lit(False))
    return df.where(F.col(nr).between(low, high)).join(allowed.select(nr).distinct(), nr, "left_semi")


GAF_COLUMNS = (
    "DB", "DB_Object_ID", "DB_Object_Symbol", "Qualifier", "GO_ID", "DB_Reference", "Evidence", "With", "Aspect", "DB_Object_Name", "Synonym",
    "DB_Object_Type", "Taxon_ID", "Date", "Assigned_By", "Annotation_Extension", "Gene_Product_Form_ID",
)


def to_gaf(annotations: DataFrame, entries: DataFrame, terms: DataFrame, *, db: str, date: str, object_id: str = "protein_id") -> DataFrame:
    """Annotations in the 17 columns of GAF 2.1; obsolete terms are left out."""
    j = annotations.join(terms.select("term_nr", "aspect"), "term_nr").join(entries.select("entry_nr", F.col(object_id).alias("__id"), "taxid"), "entry_nr")
    blank = F.lit("")
    values: list[Column] = [
        F.lit(db), F.col("__id"), F.col("__id"), blank, term_id("term_nr"), F.col("reference"), F.col("evidence"), blank, F.coalesce(aspect_letter("aspect"), blank), blank, blank,
        F.lit("protein"), F.concat(F.lit("taxon:"), F.col("taxid")), F.lit(date), F.lit(db), blank, blank,
    ]
    return j.select(*[v.alias(n) for v, n in zip(values, GAF_COLUMNS, strict=True)])


def evidence_summary(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: distinct annotations (entry and term) in all and by class of evidence (experimental, curated
    by other means, electronic; an annotation may be in several), and annotated proteins in all, in flat and in hierarchical groups."""
    ev = F.col("evidence")
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    per = annotations.groupBy("entry_nr", "term_nr").agg(
        flag(ev.isin(*EXPERIMENTAL)).alias("x"), flag((ev != "IEA") & ~ev.isin(*EXPERIMENTAL)).alias("c"), flag(ev == "IEA").alias("e")
    )
    entry = per.groupBy("entry_nr").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in "xce"])
    j = entry.join(entries.select("entry_nr", "group_nr", "hog_id"), "entry_nr")
    return j.agg(
        F.sum("n").alias("annotations"), F.sum("x").alias("experimental"), F.sum("c").alias("curated"), F.sum("e").alias("electronic"), F.count(F.lit(1)).alias("proteins"),
        F.count(F.when(F.col("group_nr") != 0, 1)).alias("proteins_in_group"), F.count(F.when(F.col("hog_id") != "", 1)).alias("proteins_in_hog"),
    )


def genome_importance(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """(species_code, n_exp, n_cur, priority): genomes ranked by experimental, then other non-electronic annotations (0 is best)."""
    from pyspark.sql import Window

    ev = F.col("evidence")
    strong = ev.isin(*EXPERIMENTAL, *HIGH_THROUGHPUT)
    per = annotations.where(ev != "IEA").groupBy("entry_nr").agg(F.count(F.when(strong, 1)).alias("n_exp"), F.count(F.when(~strong, 1)).alias("n_cur"))
    g = entries.select("entry_nr", "species_code").join(per, "entry_nr", "left").groupBy("species_code").agg(F.coalesce(F.sum("n_exp"), F.lit(0)).alias("n_exp"), F.coalesce(F.sum("n_cur"), F.lit(0)).alias("n_cur"))
    return g.withColumn("priority", F.row_number().over(Window.orderBy(F.desc("n_exp"), F.desc("n_cur"), "species_code")) - 1)


def coverage(domains: DataFrame, *, start: str = "dom_start", end: str = "dom_end") -> DataFrame:
    """(entry_nr, covered): sites of each protein inside domains, segments added up as delivered."""
    return domains.groupBy("entry_nr").agg(F.sum(F.col(end) - F.col(start) + 1).alias("covered"))


def segment_length(coords) -> Column:
    """Total length of segments written ``a:b[:c:d...]``; an odd last number is ignored."""
    c = F.col(coords) if isinstance(coords, str) else coords
    n = F.transform(F.split(c, ":"), lambda x: x.try_cast("bigint"))
    pairs = F.sequence(F.lit(1), F.greatest(F.floor(F.size(n) / 2), F.lit(1)).cast("int"))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(F.try_element_at(n, i * 2) - F.try_element_at(n, i * 2 - 1) + 1, F.lit(0)))
    return F.when(c.isNotNull(), total)


def histogram(values: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, upper, n) of values in (0, 1] over equal bins, the last one closed; zero and null are left out."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int")
    return values.where(F.col(col) > 0).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("upper", (F.col("bin") + 1) / bins)


def architectures(domains: DataFrame) -> DataFrame:
    """(entry_nr, arch): ordered domain ids of each protein."""
    parts = F.array_sort(F.collect_list(F.struct("dom_start", "domain_id")))
    return domains.groupBy("entry_nr").agg(F.array_join(F.transform(parts, lambda x: x["domain_id"]), ",").alias("arch"))


def prevalent_architectures(domains: DataFrame, entries: DataFrame, *, min_size: int = 2, min_count: int = 1) -> DataFrame:
    """(fam, arch, n, fam_size, representative): the most frequent domain architecture of each family.

    Families of more than ``min_size`` members and architectures of more than
    ``min_count`` proteins; the representative is the first entry with it. Ties go to the
    alphabetically first architecture.
    """
    size = entries.where("fam IS NOT NULL").groupBy("fam").agg(F.count(F.lit(1)).alias("fam_size"))
    a = architectures(domains).join(entries.where("fam IS NOT NULL").select("entry_nr", "fam"), "entry_nr")
    counts = a.groupBy("fam", "arch").agg(F.count(F.lit(1)).alias("n"), F.min("entry_nr").alias("representative"))
    best = counts.groupBy("fam").agg(F.min(F.struct((-F.col("n")).alias("m"), "arch", "representative")).alias("b"))
    out = best.select("fam", "b.arch", (-F.col("b.m")).alias("n"), F.col("b.representative").alias("representative"))
    return out.join(size, "fam").where((F.col("fam_size") > min_size) & (F.col("n") > min_count))


def similar_families(archs: DataFrame, fam: int) -> DataFrame:
    """(fam, overlap, prevalence) of the other families by multiset overlap of their domains with those of ``fam``."""
    d = archs.select("fam", "n", "fam_size", F.explode(F.split("arch", ",")).alias("d")).groupBy("fam", "n", "fam_size", "d").agg(F.count(F.lit(1)).alias("c"))
    q = d.where(F.col("fam") == fam).select("d", F.col("c").alias("cq"))
    j = d.where(F.col("fam") != fam).join(q, "d").groupBy("fam", "n", "fam_size").agg(F.sum(F.least("c", "cq")).alias("overlap"))
    return j.select("fam", "overlap", F.round(F.col("n") * 100.0 / F.col("fam_size"), 4).alias("prevalence"))


def concat_descriptions(rows: DataFrame, key: str, text: str, *, max_bytes: int = 65535) -> DataFrame:
    """(key, description): distinct texts joined by '; ', cut at ``max_bytes`` characters."""
    return rows.groupBy(key).agg(F.substring(F.array_join(F.array_sort(F.collect_set(text)), "; "), 1, max_bytes).alias("description"))
