"""Queries on release statistics, checks and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import annotations, scans, summary
from phylolake.operators.snapshots import latest_delivery
from phylolake.plans import build
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import table
from phylolake.sinks import writers
from phylolake.streaming import incremental

R = Registry(D.VIEWS)
Spark = SparkSession


@R.query("SELECT species_code, chromosome, max(locus_end) AS length, count(*) AS n FROM entry_v WHERE chromosome <> '' GROUP BY 1, 2")
def chromosome_lengths(s: Spark, sf: str) -> DataFrame:
    return summary.chromosome_lengths(D.entry(s, sf))


@R.query("SELECT species_code, chromosome, list(entry_nr ORDER BY locus_start, entry_nr) AS genes FROM entry_v WHERE chromosome <> '' GROUP BY 1, 2")
def chromosome_genes(s: Spark, sf: str) -> DataFrame:
    return summary.chromosome_genes(D.entry(s, sf))


@R.query("SELECT rel_type, min(score) AS q0, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90, max(score) AS q100 FROM pair_v GROUP BY 1")
def score_quantiles(s: Spark, sf: str) -> DataFrame:
    q = summary.quantiles(D.pair(s, sf), "score", ["rel_type"])
    return q.select("rel_type", "q0", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")], "q100")


def _all_releases(s: Spark, sf: str) -> DataFrame:
    last = latest_delivery(table(s, sf, "entry"), ["ReleaseNr", "EntryNr"], "DeliveredAt", {"group_nr": F.coalesce("OmaGroup", F.lit(0)), "raw": F.coalesce("OmaHOG", F.lit(""))})
    return last.select(F.col("ReleaseNr").alias("release_nr"), "EntryNr", "group_nr", hogid.plain_id("raw").alias("hog_id"), hogid.family_nr("raw").alias("fam"))


_REL = """al AS (SELECT ReleaseNr AS release_nr, g AS group_nr, trim(h) AS hog_id, try_cast(nullif(regexp_extract(h, '^\\s*HOG:[A-Za-z]*0*([0-9]+)', 1), '') AS BIGINT) AS fam FROM (SELECT ReleaseNr, EntryNr, coalesce(OmaGroup, 0) AS g, coalesce(OmaHOG, '') AS h,
  row_number() OVER (PARTITION BY ReleaseNr, EntryNr ORDER BY DeliveredAt DESC NULLS LAST, coalesce(OmaGroup, 0) DESC, coalesce(OmaHOG, '') DESC) AS rn FROM entry) WHERE rn = 1)"""


@R.query(f"""WITH {_REL}, w AS (SELECT release_nr, count(*)::DOUBLE AS n_entries, round(avg((group_nr <> 0)::INT), 9) AS in_group, round(avg((hog_id <> '')::INT), 9) AS in_hog, count(DISTINCT nullif(group_nr, 0))::DOUBLE AS n_groups, count(DISTINCT fam)::DOUBLE AS n_families FROM al GROUP BY 1)
  SELECT release_nr, statistic, value FROM (UNPIVOT w ON n_entries, in_group, in_hog, n_groups, n_families INTO NAME statistic VALUE value)""")
def release_comparison(s: Spark, sf: str) -> DataFrame:
    o = summary.release_overview(_all_releases(s, sf))
    numbers = o.select("release_nr", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in o.columns if c != "release_nr"])
    return summary.long_form(numbers, ["release_nr"])


@R.query(f"WITH {_REL}, n AS (SELECT release_nr, size, count(*) AS n FROM (SELECT release_nr, fam, count(*) AS size FROM al WHERE fam IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY release_nr ORDER BY size DESC) AS BIGINT) AS n_at_least FROM n")
def family_sizes_by_release(s: Spark, sf: str) -> DataFrame:
    return summary.size_distribution(_all_releases(s, sf), "fam")


@R.query("SELECT entry_nr, hog_id FROM entry_v WHERE fam = (SELECT min(fam) FROM entry_v WHERE fam IS NOT NULL) ORDER BY hog_id, entry_nr LIMIT 20 OFFSET 5")
def member_page(s: Spark, sf: str) -> DataFrame:
    """Rows 5 to 24 of a family in order of ids."""
    e = D.entry(s, sf)
    return scans.page(e.where(F.col("fam") == e.agg(F.min("fam")).first()[0]).select("entry_nr", "hog_id"), ["hog_id", "entry_nr"], 5, 25)


@R.query("""WITH i AS (SELECT e.species_code, count(*) FILTER (WHERE evidence IN ('EXP','IDA','IPI','IMP','IGI','IEP','HTP','HDA','HMP','HGI','HEP')) AS x, count(*) FILTER (WHERE evidence <> 'IEA' AND evidence NOT IN ('EXP','IDA','IPI','IMP','IGI','IEP','HTP','HDA','HMP','HGI','HEP')) AS c FROM entry_v e LEFT JOIN go_v g ON g.entry_nr = e.entry_nr GROUP BY 1),
  p AS (SELECT species_code, row_number() OVER (ORDER BY x DESC, c DESC, species_code) - 1 AS priority FROM i) SELECT e.entry_nr, p.priority FROM entry_v e JOIN p USING (species_code) WHERE e.group_nr <> 0 ORDER BY priority, entry_nr LIMIT 50""")
def top_entries_by_importance(s: Spark, sf: str) -> DataFrame:
    """The fifty grouped entries of the best annotated genomes."""
    e = D.entry(s, sf)
    return summary.sorted_by_importance(e.where("group_nr <> 0"), annotations.genome_importance(D.go(s, sf), e)).select("entry_nr", "priority").limit(50)


@R.query("SELECT entry_nr, alt_splice FROM entry_v WHERE alt_splice <> 0 AND alt_splice NOT IN (SELECT entry_nr FROM entry_v WHERE alt_splice = entry_nr)")
def check_isoforms(s: Spark, sf: str) -> DataFrame:
    return summary.isoforms_without_main(D.entry(s, sf)).select("entry_nr", F.col("alt_splice").cast("int").alias("alt_splice"))


@R.query("SELECT species_code, taxid FROM genome_v WHERE polyploid = 0 AND species_code IN (SELECT species_code FROM entry_v WHERE subgenome <> '')")
def check_polyploids(s: Spark, sf: str) -> DataFrame:
    return summary.unmarked_polyploids(D.entry(s, sf), D.genome(s, sf)).select("species_code", "taxid")


@R.query("""SELECT 'range' AS check_name, count(*) AS n FROM entry_v e JOIN genome_v g USING (species_code) WHERE NOT (e.entry_nr > g.entry_off AND e.entry_nr <= g.entry_off + g.tot_entries)
  UNION ALL SELECT 'overlap', count(*) FROM (SELECT entry_off, lag(entry_off + tot_entries) OVER (ORDER BY entry_off) AS e FROM genome_v) WHERE entry_off < e""")
def check_genome_ranges(s: Spark, sf: str) -> DataFrame:
    g, e = D.genome(s, sf), D.entry(s, sf)
    a = summary.outside_their_genome(e, g).agg(F.count(F.lit(1)).alias("n")).select(F.lit("range").alias("check_name"), "n")
    return a.unionByName(summary.overlapping_genomes(g).agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlap").alias("check_name"), "n"))


@R.query("""SELECT x.xref_id, 'FP' || lpad(CAST(e.group_nr AS VARCHAR), 5, '0') AS fingerprint FROM xref_v x JOIN entry_v e ON e.entry_nr = x.entry_nr WHERE x.source = 10 AND e.group_nr <> 0 AND e.group_nr % 10 <> 0 GROUP BY ALL""")
def fingerprint_crosslinks(s: Spark, sf: str) -> DataFrame:
    e = D.entry(s, sf)
    fp = F.when(F.col("group_nr") % 10 == 0, "n/a").otherwise(F.format_string("FP%05d", "group_nr"))
    g = e.where("group_nr <> 0").select("group_nr").distinct().withColumn("fingerprint", fp)
    return writers.fingerprint_links(D.xref(s, sf), e, g, source=10)


@R.query("""SELECT species_code, count(*) AS n FROM (SELECT x.xref_id AS object_id, e.species_code, g.tot_entries FROM xref_v x JOIN entry_v e ON e.entry_nr = x.entry_nr JOIN genome_v g USING (species_code) WHERE x.source = 10
  ORDER BY CASE WHEN regexp_matches(e.species_code, '^(A|B)') THEN 0 ELSE 1 END, g.tot_entries DESC, object_id LIMIT 40) GROUP BY 1""")
def prioritised_links(s: Spark, sf: str) -> DataFrame:
    links = D.xref(s, sf).where("source = 10").select(F.col("xref_id").alias("object_id"), "entry_nr").join(D.entry(s, sf).select("entry_nr", "species_code"), "entry_nr")
    return writers.prioritised(links, D.genome(s, sf), prefixes=("A", "B"), limit=40).groupBy("species_code").agg(F.count(F.lit(1)).alias("n"))


@R.query()
def family_json(s: Spark, sf: str) -> DataFrame:
    return writers.family_json(D.entry(s, sf), chunk_members=50_000)


@R.query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_per_day(s: Spark, sf: str) -> DataFrame:
    return incremental.windowed_counts(table(s, sf, "events")).withColumn("total", F.round("total", 4))


@R.query("SELECT species_code, CAST(coalesce(sum(tot_entries) OVER (ORDER BY species_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS entry_off FROM genome_v")
def genome_offsets(s: Spark, sf: str) -> DataFrame:
    return build.genome_offsets(D.genome(s, sf).drop("entry_off")).select("species_code", "entry_off")


@R.query("SELECT entry_nr, string_agg(DISTINCT xref_id, '; ' ORDER BY xref_id) AS description FROM xref_v WHERE source IN (110, 115) GROUP BY 1")
def joined_names(s: Spark, sf: str) -> DataFrame:
    return annotations.concat_descriptions(D.xref(s, sf).where("source IN (110, 115)"), "entry_nr", "xref_id")


@R.query("""WITH p AS (SELECT p.entry_nr1, p.entry_nr2, a.species_code AS s1, b.species_code AS s2, CASE WHEN p.score > 500 THEN 6 ELSE rel_type END AS rt FROM pair_v p JOIN entry_v a ON a.entry_nr = p.entry_nr1 JOIN entry_v b ON b.entry_nr = p.entry_nr2 WHERE rel_type <= 3),
  c AS (SELECT *, count(*) OVER (PARTITION BY entry_nr2, s1) AS m, count(*) OVER (PARTITION BY entry_nr1, s2) AS n FROM p) SELECT entry_nr1, entry_nr2, CAST(CASE WHEN rt <> 6 THEN rt WHEN m > 1 AND n > 1 THEN 3 WHEN m > 1 THEN 2 WHEN n > 1 THEN 1 ELSE 0 END AS INT) AS rel_type FROM c""")
def inferred_types(s: Spark, sf: str) -> DataFrame:
    """Unknown relation types (here: of high scores) filled in from the pairs themselves."""
    p = D.pair(s, sf).where("rel_type <= 3").withColumn("rel_type", F.when(F.col("score") > 500, 6).otherwise(F.col("rel_type")))
    return build.typed_relations(p, D.entry(s, sf)).select("entry_nr1", "entry_nr2", F.col("rel_type").cast("int").alias("rel_type"))


@R.query("""WITH lv AS (SELECT DISTINCT h.fam, h.hog_id, l.rn FROM hog_v h JOIN level_v l USING (level)), n AS (SELECT fam, rn, count(DISTINCT hog_id) AS n FROM lv GROUP BY 1, 2),
  j AS (SELECT a.fam, l.rn, a.n AS na, b.n FROM n a JOIN level_v l ON l.rn // 2 = a.rn LEFT JOIN n b ON b.fam = a.fam AND b.rn = l.rn)
  SELECT event, count(*) AS n FROM (SELECT 'presence' AS event FROM n UNION ALL SELECT 'loss' FROM j WHERE n IS NULL UNION ALL SELECT 'duplication' FROM j WHERE n > na) GROUP BY 1""")
def profile_events(s: Spark, sf: str) -> DataFrame:
    """Presence, losses and duplications of all families over the level tree."""
    lv = D.levels(s, sf)
    levels = D.hog(s, sf).join(lv, "level").select("fam", "hog_id", F.col("rn").alias("taxid")).distinct()
    tree = lv.select(F.col("rn").alias("taxid"), F.floor(F.col("rn") / 2).cast("int").alias("parent_taxid"))
    return build.tree_profiles(levels, tree).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = R.queries, R.sql
