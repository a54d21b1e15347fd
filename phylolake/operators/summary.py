"""Release statistics: chromosomes, quantiles, comparisons between releases, consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chromosome_lengths(entries: DataFrame) -> DataFrame:
    """(species_code, chromosome, length, n): largest locus end and number of genes of every chromosome."""
    return entries.where("chromosome <> ''").groupBy("species_code", "chromosome").agg(F.max("locus_end").alias("length"), F.count(F.lit(1)).alias("n"))


def chromosome_genes(entries: DataFrame) -> DataFrame:
    """(species_code, chromosome, genes): entry numbers in order of position."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("locus_start", "entry_nr"))), lambda x: x["entry_nr"])
    return entries.where("chromosome <> ''").groupBy("species_code", "chromosome").agg(genes.alias("genes"))


def quantiles(df: DataFrame, value: str, by: list[str] | None = None, at: tuple[float, ...] = (0.0, 0.1, 0.5, 0.9, 1.0)) -> DataFrame:
    """Exact interpolated quantiles per group as columns q0, q10, ..."""
    q = F.percentile(value, [float(x) for x in at])
    out = df.groupBy(*(by or [])).agg(q.alias("__q"))
    return out.select(*(by or []), *[F.col("__q")[i].alias(f"q{round(x * 100)}") for i, x in enumerate(at)])


def release_overview(entries: DataFrame, release: str = "release_nr") -> DataFrame:
    """Per release: entries, share in a flat group, in a hierarchical group, numbers of groups and mean sizes."""
    g = entries.groupBy(release).agg(
        F.count(F.lit(1)).alias("n_entries"), F.avg(F.when(F.col("group_nr") != 0, 1.0).otherwise(0.0)).alias("in_group"), F.avg(F.when(F.col("hog_id") != "", 1.0).otherwise(0.0)).alias("in_hog"),
        F.countDistinct(F.when(F.col("group_nr") != 0, F.col("group_nr"))).alias("n_groups"), F.countDistinct("fam").alias("n_families"),
    )
    return g


def size_distribution(entries: DataFrame, key: str, release: str = "release_nr") -> DataFrame:
    """(release, size, n, n_at_least): group sizes per release with the number of groups of at least that size."""
    n = entries.where(F.col(key).isNotNull()).groupBy(release, key).agg(F.count(F.lit(1)).alias("size")).groupBy(release, "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(release).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("n_at_least", F.sum("n").over(w))


def long_form(df: DataFrame, keys: list[str], name: str = "statistic", value: str = "value") -> DataFrame:
    """One row per key and statistic."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def sorted_by_importance(entries: DataFrame, importance: DataFrame) -> DataFrame:
    """Entries in order of their genome's priority, then number; genomes without one come last."""
    j = entries.join(importance.select("species_code", "priority"), "species_code", "left")
    return j.orderBy(F.asc_nulls_last("priority"), "entry_nr")


def group_fingerprint_lookup(groups: DataFrame, query: str) -> DataFrame:
    """Flat groups named by number or by their fingerprint of seven letters."""
    q = query.strip()
    return groups.where(F.col("group_nr") == int(q)) if q.isdigit() else groups.where(F.upper("fingerprint") == q.upper())


# -- consistency checks: each gives the offending rows ------------------------------------


def outside_their_genome(entries: DataFrame, genomes: DataFrame) -> DataFrame:
    g = genomes.select("species_code", "entry_off", "tot_entries")
    return entries.join(g, "species_code").where(~F.col("entry_nr").between(F.col("entry_off") + 1, F.col("entry_off") + F.col("tot_entries")))


def overlapping_genomes(genomes: DataFrame) -> DataFrame:
    """Genomes whose entry range starts inside the one before."""
    w = Window.orderBy("entry_off")
    return genomes.withColumn("__end", F.lag(F.col("entry_off") + F.col("tot_entries")).over(w)).where(F.col("entry_off") < F.col("__end")).drop("__end")


def unmarked_polyploids(entries: DataFrame, genomes: DataFrame) -> DataFrame:
    """Genomes with sub-genomes that are not flagged as polyploid."""
    sub = entries.where("subgenome <> ''").select("species_code").distinct()
    return genomes.join(sub, "species_code", "left_semi").where("polyploid = 0")


def isoforms_without_main(entries: DataFrame) -> DataFrame:
    """Entries whose main isoform is not an entry of the release."""
    main = entries.where("alt_splice = entry_nr").select(F.col("entry_nr").alias("alt_splice"))
    return entries.where("alt_splice <> 0").withColumn("alt_splice", F.col("alt_splice").cast("bigint")).join(main, "alt_splice", "left_anti")


def stored_differs(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys for which a materialised table and its recomputation disagree (missing counts as a difference)."""
    a = stored.select(*keys, F.struct(*columns).alias("stored"))
    b = fresh.select(*keys, F.struct(*columns).alias("fresh"))
    return a.join(b, keys, "full").where(~F.col("stored").eqNullSafe(F.col("fresh")))


def genetic_code_mismatch(df: DataFrame, cdna: str, protein: str) -> DataFrame:
    """Rows whose coding sequence is not three times as long as the protein (stop codon allowed)."""
    extra = F.length(cdna) - 3 * F.length(protein)
    return df.where(~extra.isin(0, 3) | extra.isNull())


def row_order_breaks(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value is smaller than that of the row before."""
    w = Window.orderBy(order)
    return df.withColumn("__before", F.lag(value).over(w)).where(F.col(value) < F.col("__before")).drop("__before")
