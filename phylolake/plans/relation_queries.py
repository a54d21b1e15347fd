"""Queries on entries, relations, groups and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import groups, hierarchy, joins, relations
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import table

R = Registry(D.VIEWS)
Spark = SparkSession

# first token at which two ids differ, as an index from 1 (NULL: none)
_FIRST = """list_filter(range(1, CAST(least(len(t1), len(t2)) AS BIGINT) + 1), lambda i: t1[i] <> t2[i])[1]"""
_ORTHO = f"""CASE WHEN {_FIRST} IS NULL THEN TRUE WHEN {_FIRST} = 1 THEN FALSE
  ELSE regexp_extract(t1[{_FIRST}], '^([0-9]+)', 1) <> regexp_extract(t2[{_FIRST}], '^([0-9]+)', 1) END"""
_TOKENS = "string_split(a.hog_id, '.') AS t1, string_split(b.hog_id, '.') AS t2"


@R.query(f"""WITH p AS (SELECT a.entry_nr AS entry_nr1, b.entry_nr AS entry_nr2, a.species_code AS species_code1, b.species_code AS species_code2, a.fam,
    a.group_nr AS g1, b.group_nr AS g2, {_TOKENS} FROM main_v a JOIN main_v b ON a.fam = b.fam AND a.species_code < b.species_code WHERE a.hog_id <> '' AND b.hog_id <> ''),
  o AS (SELECT * FROM p WHERE {_ORTHO})
  SELECT entry_nr1, entry_nr2, species_code1, species_code2, fam,
    CASE WHEN count(*) OVER (PARTITION BY entry_nr2, species_code1) > 1 THEN 'm' ELSE '1' END || ':' || CASE WHEN count(*) OVER (PARTITION BY entry_nr1, species_code2) > 1 THEN 'n' ELSE '1' END AS rel_label,
    CASE WHEN g1 = g2 AND g1 <> 0 THEN g1 END AS shared_group FROM o""")
def hog_induced_orthologs(s: Spark, sf: str) -> DataFrame:
    return relations.induced_orthologs(D.main(s, sf))


@R.query(f"""SELECT entry_nr1, entry_nr2, common_id FROM (SELECT a.entry_nr AS entry_nr1, b.entry_nr AS entry_nr2, {_TOKENS},
    array_to_string(list_slice(t1, 1, {_FIRST} - 1), '.') AS common_id
    FROM main_v a JOIN main_v b ON a.fam = b.fam AND a.species_code < b.species_code WHERE a.hog_id <> '' AND b.hog_id <> '') WHERE NOT ({_ORTHO})""")
def induced_paralog_pairs(s: Spark, sf: str) -> DataFrame:
    return relations.induced_pairs(D.main(s, sf), orthologs=False).select("entry_nr1", "entry_nr2", hogid.common_group("hog_id1", "hog_id2").alias("common_id"))


_LEVELS = "lv AS (SELECT h.hog_id, CAST(l.rn AS BIGINT) AS level_taxid FROM hog_v h JOIN level_v l ON h.level = l.level)"


def _levels_with_taxid(s: Spark, sf: str) -> DataFrame:
    lv = D.levels(s, sf).select("level", F.col("rn").cast("bigint").alias("level_taxid"))
    return D.hog(s, sf).join(lv, "level")


def _closure(s: Spark, sf: str) -> DataFrame:
    return D.tax_tree(s, sf)


@R.query(f"""WITH {_LEVELS},
  p AS (SELECT entry_nr1, entry_nr2, taxid, array_to_string(list_slice(t1, 1, {_FIRST} - 1), '.') AS common_id FROM (SELECT a.entry_nr AS entry_nr1, b.entry_nr AS entry_nr2, a.taxid, {_TOKENS}
    FROM main_v a JOIN main_v b ON a.fam = b.fam AND a.species_code < b.species_code WHERE a.hog_id <> '' AND b.hog_id <> '') WHERE NOT ({_ORTHO})),
  d AS (SELECT entry_nr1, entry_nr2, p.taxid, common_id, greatest(min(c.dist) - 1, 0) AS d FROM p JOIN lv ON lv.hog_id = p.common_id
    JOIN tax_closure c ON c.descendant = p.taxid AND c.ancestor = lv.level_taxid GROUP BY ALL)
  SELECT entry_nr1, entry_nr2, common_id, c.ancestor AS divergence_taxid FROM d JOIN tax_closure c ON c.descendant = d.taxid AND c.dist = d.d""")
def paralog_divergence_level(s: Spark, sf: str) -> DataFrame:
    return relations.induced_paralogs(D.main(s, sf), _levels_with_taxid(s, sf), _closure(s, sf))


@R.query("""WITH p AS (SELECT p.entry_nr1, p.entry_nr2, a.species_code AS s1, b.species_code AS s2 FROM pair_v p JOIN entry_v a ON a.entry_nr = p.entry_nr1 JOIN entry_v b ON b.entry_nr = p.entry_nr2 WHERE p.rel_type <= 3)
  SELECT entry_nr1, entry_nr2, CASE WHEN count(*) OVER (PARTITION BY entry_nr2, s1) > 1 THEN 'm' ELSE '1' END || ':' || CASE WHEN count(*) OVER (PARTITION BY entry_nr1, s2) > 1 THEN 'n' ELSE '1' END AS rel_label FROM p""")
def ortholog_rel_type(s: Spark, sf: str) -> DataFrame:
    g = D.entry(s, sf).select("entry_nr", "species_code")
    p = D.pair(s, sf).where("rel_type <= 3").join(g.toDF("entry_nr1", "s1"), "entry_nr1").join(g.toDF("entry_nr2", "s2"), "entry_nr2")
    return relations.cardinality(p, "entry_nr1", "entry_nr2", ["s1"], ["s2"]).select("entry_nr1", "entry_nr2", "rel_label")


@R.query("SELECT entry_nr1, entry_nr2, ['1:1','1:n','m:1','m:n','close paralog','homeolog','n/a'][rel_type + 1] AS rel_label, score FROM pair_v")
def pairwise_decoded(s: Spark, sf: str) -> DataFrame:
    return D.pair(s, sf).select("entry_nr1", "entry_nr2", relations.type_label("rel_type").alias("rel_label"), "score")


@R.query("""SELECT a.species_code AS genome1, b.species_code AS genome2, count(*) AS n FROM pair_v p JOIN entry_v a ON a.entry_nr = p.entry_nr1 JOIN entry_v b ON b.entry_nr = p.entry_nr2
  WHERE p.rel_type <= 3 GROUP BY ALL""")
def pairs_between_genomes(s: Spark, sf: str) -> DataFrame:
    g = D.entry(s, sf).select("entry_nr", "species_code")
    p = D.pair(s, sf).where("rel_type <= 3").join(g.toDF("entry_nr1", "genome1"), "entry_nr1").join(g.toDF("entry_nr2", "genome2"), "entry_nr2")
    return p.groupBy("genome1", "genome2").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT entry_nr1 AS entry_nr, ['1:1','1:n','m:1','m:n','close paralog','homeolog','n/a'][rel_type + 1] AS rel_label, count(*) AS n FROM pair_v GROUP BY ALL")
def relation_counts(s: Spark, sf: str) -> DataFrame:
    return relations.relation_counts(D.pair(s, sf))


@R.query("""SELECT entry_nr1, entry_nr2, count(*) OVER (PARTITION BY entry_nr1) + count(*) OVER (PARTITION BY entry_nr2) AS copy_nr FROM pair_v WHERE rel_type = 5
  AND entry_nr1 IN (SELECT entry_nr FROM main_v) AND entry_nr2 IN (SELECT entry_nr FROM main_v)""")
def homoeolog_copy_number(s: Spark, sf: str) -> DataFrame:
    m = D.main(s, sf).select("entry_nr")
    p = D.pair(s, sf).where("rel_type = 5").join(m.toDF("entry_nr1"), "entry_nr1", "left_semi").join(m.toDF("entry_nr2"), "entry_nr2", "left_semi")
    return relations.copy_number(p).select("entry_nr1", "entry_nr2", "copy_nr")


@R.query(f"""WITH e AS (SELECT entry_nr, group_nr, fam, hog_id FROM main_v),
  v AS (SELECT entry_nr1 AS x, entry_nr2 AS y FROM pair_v WHERE rel_type <= 3 UNION SELECT entry_nr2, entry_nr1 FROM pair_v WHERE rel_type <= 3),
  f AS (SELECT x, y, {_ORTHO} AS o FROM (SELECT a.entry_nr AS x, b.entry_nr AS y, {_TOKENS} FROM e a JOIN e b ON a.fam = b.fam AND a.entry_nr <> b.entry_nr WHERE a.hog_id <> '' AND b.hog_id <> '')),
  g AS (SELECT a.entry_nr AS x, b.entry_nr AS y FROM e a JOIN e b ON a.group_nr = b.group_nr AND a.group_nr <> 0 AND a.entry_nr <> b.entry_nr),
  u AS (SELECT x, y, 1 AS vp, 0 AS ho, 0 AS hp, 0 AS gr FROM v UNION ALL SELECT x, y, 0, o::INT, (NOT o)::INT, 0 FROM f UNION ALL SELECT x, y, 0, 0, 0, 1 FROM g),
  m AS (SELECT x, y, max(vp) AS vp, max(ho) AS ho, max(hp) AS hp, max(gr) AS gr FROM u GROUP BY 1, 2),
  c AS (SELECT x, sum(vp)::BIGINT AS vp, sum(ho)::BIGINT AS ho, sum(hp)::BIGINT AS hp, sum(gr)::BIGINT AS gr, sum(greatest(vp, ho, gr))::BIGINT AS n FROM m GROUP BY 1)
  SELECT e.entry_nr, coalesce(vp, 0) AS n_pairwise, coalesce(ho, 0) AS n_induced_orthologs, coalesce(hp, 0) AS n_induced_paralogs, coalesce(gr, 0) AS n_group, coalesce(n, 0) AS n_any
  FROM e LEFT JOIN c ON c.x = e.entry_nr""")
def ortholog_count_cache(s: Spark, sf: str) -> DataFrame:
    return relations.ortholog_counts(D.pair(s, sf).where("rel_type <= 3"), D.main(s, sf))


@R.query("SELECT e.entry_nr, g.species_code FROM (SELECT DISTINCT EntryNr AS entry_nr FROM entry) e JOIN genome_v g ON e.entry_nr > g.entry_off AND e.entry_nr <= g.entry_off + g.tot_entries")
def genome_of_entry_range_join(s: Spark, sf: str) -> DataFrame:
    e = table(s, sf, "entry").select(F.col("EntryNr").alias("entry_nr")).distinct()
    return joins.interval_join(e, D.genome(s, sf), "entry_nr", F.col("entry_off") + 1, F.col("entry_off") + F.col("tot_entries"), width=4096).select("entry_nr", "species_code")


@R.query("SELECT x.RowNr AS row_nr, (SELECT max(entry_off) FROM genome_v g WHERE g.entry_off < x.EntryNr) AS entry_off FROM (SELECT DISTINCT RowNr, EntryNr FROM xref WHERE EntryNr <> 0) x")
def genome_offset_asof(s: Spark, sf: str) -> DataFrame:
    x = table(s, sf, "xref").where("EntryNr <> 0").select(F.col("RowNr").alias("row_nr"), (F.col("EntryNr") - 1).alias("pos")).distinct()
    g = D.genome(s, sf).select(F.col("entry_off").alias("off"), "entry_off")
    return joins.asof_join(x, g, "pos", "off", "entry_off", width=4096).select("row_nr", "entry_off")


@R.query("SELECT species_code, count(*) AS n FROM main_v GROUP BY 1")
def main_isoform_count(s: Spark, sf: str) -> DataFrame:
    return D.entry(s, sf).where(relations.is_main_isoform()).groupBy("species_code").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT CASE WHEN alt_splice = 0 THEN entry_nr ELSE alt_splice END AS gene, list_sort(list(entry_nr)) AS isoforms, count(*) AS n FROM entry_v GROUP BY 1")
def isoforms_of_gene(s: Spark, sf: str) -> DataFrame:
    gene = F.coalesce(F.nullif(F.col("alt_splice"), F.lit(0)).cast("bigint"), F.col("entry_nr"))
    return D.entry(s, sf).groupBy(gene.alias("gene")).agg(F.array_sort(F.collect_list("entry_nr")).alias("isoforms"), F.count(F.lit(1)).alias("n"))


@R.query("""SELECT species_code, island, min(entry_nr) AS first, max(entry_nr) + 1 AS stop FROM
  (SELECT species_code, entry_nr, entry_nr - row_number() OVER (PARTITION BY species_code ORDER BY entry_nr) AS island FROM entry_v) GROUP BY 1, 2""")
def entry_islands(s: Spark, sf: str) -> DataFrame:
    w = Window.partitionBy("species_code").orderBy("entry_nr")
    e = D.entry(s, sf).withColumn("island", F.col("entry_nr") - F.row_number().over(w))
    return e.groupBy("species_code", "island").agg(F.min("entry_nr").alias("first"), (F.max("entry_nr") + 1).alias("stop"))


@R.query("SELECT size, count(*) AS n_groups FROM (SELECT group_nr, count(*) AS size FROM entry_v WHERE group_nr <> 0 GROUP BY 1) GROUP BY 1")
def group_size_hist(s: Spark, sf: str) -> DataFrame:
    return groups.size_histogram(D.entry(s, sf), "group_nr", 0)


@R.query("""SELECT size, n_groups, CAST(sum(n_groups) OVER (ORDER BY size DESC) AS BIGINT) AS n_at_least FROM
  (SELECT size, count(*) AS n_groups FROM (SELECT fam, count(*) AS size FROM entry_v WHERE fam IS NOT NULL GROUP BY 1) GROUP BY 1)""")
def family_size_hist(s: Spark, sf: str) -> DataFrame:
    """Histogram of family sizes with the number of families of at least that size (few rows: distinct sizes)."""
    h = groups.size_histogram(D.entry(s, sf), "fam")
    return h.withColumn("n_at_least", F.sum("n_groups").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)))


@R.query("""WITH g AS (SELECT DISTINCT group_nr AS k, species_code AS g FROM entry_v WHERE group_nr <> 0)
  SELECT a.g AS genome1, b.g AS genome2, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.g <= b.g GROUP BY ALL""")
def shared_groups_matrix(s: Spark, sf: str) -> DataFrame:
    return groups.shared_groups(D.entry(s, sf), "group_nr", 0)


@R.query("""WITH g AS (SELECT DISTINCT fam AS k, species_code AS g FROM entry_v WHERE fam IS NOT NULL)
  SELECT a.g AS genome1, b.g AS genome2, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.g <= b.g GROUP BY ALL""")
def shared_families_matrix(s: Spark, sf: str) -> DataFrame:
    return groups.shared_groups(D.entry(s, sf), "fam")


@R.query("SELECT species_code AS genome, count(*) AS n FROM entry_v WHERE group_nr <> 0 GROUP BY 1")
def genes_in_groups(s: Spark, sf: str) -> DataFrame:
    return groups.genes_in_groups(D.entry(s, sf), "group_nr", 0)


@R.query("""WITH g AS (SELECT DISTINCT group_nr AS k, species_code AS g FROM entry_v WHERE group_nr <> 0), f AS (SELECT min(species_code) AS s FROM genome_v)
  SELECT b.g AS genome, count(*) AS n FROM g a JOIN g b ON a.k = b.k AND a.g <> b.g JOIN f ON a.g = f.s GROUP BY 1 ORDER BY n DESC, genome LIMIT 10""")
def most_similar_genomes(s: Spark, sf: str) -> DataFrame:
    first = D.genome(s, sf).agg(F.min("species_code")).first()[0]
    return groups.most_similar_genomes(groups.shared_groups(D.entry(s, sf), "group_nr", 0), first, 10)


_UP = "unnest(list_transform(range(1, len(string_split(hog_id, '.')) + 1), lambda i: array_to_string(list_slice(string_split(hog_id, '.'), 1, i), '.')))"


@R.query(f"SELECT hog_id, count(*) AS n FROM (SELECT {_UP} AS hog_id FROM entry_v WHERE hog_id <> '') GROUP BY 1")
def hog_rollup_counts(s: Spark, sf: str) -> DataFrame:
    return groups.rollup_sizes(D.entry(s, sf))


@R.query(f"""WITH c AS (SELECT hog_id, group_nr, count(*) AS n FROM (SELECT {_UP} AS hog_id, group_nr FROM entry_v WHERE hog_id <> '' AND group_nr <> 0) GROUP BY 1, 2)
  SELECT hog_id, group_nr, n FROM (SELECT *, row_number() OVER (PARTITION BY hog_id ORDER BY n DESC, group_nr) AS rn FROM c) WHERE rn = 1""")
def hog_to_group_mode(s: Spark, sf: str) -> DataFrame:
    return groups.mode_group(D.entry(s, sf))


@R.query("""WITH big AS (SELECT fam FROM entry_v WHERE fam IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fam LIMIT 1), q AS (SELECT 'HOG:E' || lpad(CAST(fam AS VARCHAR), 7, '0') AS h FROM big)
  SELECT entry_nr, hog_id FROM entry_v, q WHERE hog_id = h OR starts_with(hog_id, h || '.')""")
def prefix_members(s: Spark, sf: str) -> DataFrame:
    """Members of the largest family by id prefix with token boundary."""
    e = D.entry(s, sf)
    fam = e.where("fam IS NOT NULL").groupBy("fam").count().orderBy(F.desc("count"), "fam").first()[0]
    return groups.members(e, f"HOG:E{fam:07d}").select("entry_nr", "hog_id")


@R.query(f"""WITH i AS (SELECT DISTINCT hog_id AS h FROM hog_v), u AS (SELECT h, {_UP} AS parent_id FROM (SELECT h, h AS hog_id FROM i))
  SELECT u.h AS hog_id, u.parent_id, v.level FROM u JOIN hog_v v ON v.hog_id = u.parent_id""")
def parent_hogs(s: Spark, sf: str) -> DataFrame:
    h = D.hog(s, sf)
    return groups.parent_hogs(h.select("hog_id").distinct(), h)


def _two_levels(s: Spark, sf: str):
    h = D.hog(s, sf)
    top = [r[0] for r in h.groupBy("level").count().orderBy(F.desc("count"), "level").limit(2).collect()]
    return (h.where(F.col("level") == x) for x in top)


@R.query(f"""WITH t AS (SELECT level, row_number() OVER (ORDER BY count(*) DESC, level) AS rn FROM hog_v GROUP BY level),
  p AS (SELECT DISTINCT hog_id FROM hog_v JOIN t USING (level) WHERE rn = 1), c AS (SELECT DISTINCT hog_id FROM hog_v JOIN t USING (level) WHERE rn = 2),
  u AS (SELECT c.hog_id AS child, {_UP.replace('hog_id', 'c.hog_id')} AS hog_id FROM c), m AS (SELECT u.* FROM u JOIN p ON p.hog_id = u.hog_id)
  SELECT child AS hog_id, 'retained' AS event FROM m WHERE child = hog_id
  UNION ALL SELECT DISTINCT child, 'duplicated' FROM m WHERE child NOT IN (SELECT child FROM m WHERE child = hog_id)
  UNION ALL SELECT hog_id, 'lost' FROM p WHERE hog_id NOT IN (SELECT hog_id FROM m)
  UNION ALL SELECT hog_id, 'gained' FROM c WHERE hog_id NOT IN (SELECT child FROM m)""")
def level_events(s: Spark, sf: str) -> DataFrame:
    return groups.compare_levels(*_two_levels(s, sf))


@R.query("""SELECT event, count(*) AS n FROM (SELECT CASE WHEN p.hog_id IS NULL THEN 'other' ELSE 'retained' END AS event FROM
  (SELECT DISTINCT h.hog_id, l.rn FROM hog_v h JOIN level_v l USING (level)) c LEFT JOIN (SELECT DISTINCT h.hog_id, l.rn FROM hog_v h JOIN level_v l USING (level)) p
  ON p.hog_id = c.hog_id AND p.rn = c.rn // 2 WHERE c.rn > 1) GROUP BY 1""")
def retained_per_tree_edge(s: Spark, sf: str) -> DataFrame:
    """Groups kept from the parent level, counted over all edges of the level tree at once."""
    lv = D.levels(s, sf)
    h = D.hog(s, sf).join(lv, "level").select("hog_id", "rn").distinct()
    c = h.where("rn > 1").withColumn("up", F.floor(F.col("rn") / 2).cast("int"))
    j = c.join(h.select("hog_id", F.col("rn").alias("up"), F.lit(True).alias("kept")), ["hog_id", "up"], "left")
    return j.groupBy(F.when(F.col("kept"), "retained").otherwise("other").alias("event")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT level, hog_id, row_number() OVER (PARTITION BY level ORDER BY hog_id) - 1 AS idx_per_level FROM hog_v")
def hog_level_index(s: Spark, sf: str) -> DataFrame:
    return groups.level_index(D.hog(s, sf).select("level", "hog_id"))


@R.query("SELECT level, count(*) AS n, count(*) FILTER (WHERE completeness > 0.5) AS n_complete FROM hog_v GROUP BY 1")
def hogs_per_level(s: Spark, sf: str) -> DataFrame:
    return D.hog(s, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("completeness") > 0.5, 1)).alias("n_complete"))


@R.query("SELECT fam, CAST(sum(n) OVER (ORDER BY fam) AS BIGINT) - n AS start, CAST(sum(n) OVER (ORDER BY fam) AS BIGINT) AS stop FROM (SELECT fam, count(*) AS n FROM hog_v GROUP BY 1)")
def family_row_ranges(s: Spark, sf: str) -> DataFrame:
    return groups.family_ranges(D.hog(s, sf))


@R.query("SELECT fam, hog_id, level, nr_members FROM hog_v WHERE is_root AND NOT contains(hog_id, '.')")
def root_hogs(s: Spark, sf: str) -> DataFrame:
    return D.hog(s, sf).where(~F.col("hog_id").contains(".") & F.col("is_root")).select("fam", "hog_id", "level", "nr_members")


@R.query(f"""WITH {_LEVELS}, b AS (SELECT h.fam, h.hog_id, lv.level_taxid, c.dist FROM (SELECT DISTINCT fam, hog_id FROM hog_v) h JOIN lv ON lv.hog_id = h.hog_id JOIN tax_closure c ON c.descendant = lv.level_taxid AND c.ancestor = 2),
  f AS (SELECT fam, min(dist) AS d FROM b GROUP BY 1), t AS (SELECT b.fam, min(level_taxid) AS t FROM b JOIN f ON f.fam = b.fam AND f.d = b.dist GROUP BY 1)
  SELECT b.fam, b.hog_id, b.level_taxid, b.dist FROM b JOIN t ON t.fam = b.fam AND t.t = b.level_taxid""")
def hogs_at_closest_level(s: Spark, sf: str) -> DataFrame:
    return groups.closest_level(_levels_with_taxid(s, sf).select("fam", "hog_id", "level_taxid"), _closure(s, sf), 2).select("fam", "hog_id", "level_taxid", "dist")


@R.query("""WITH lv AS (SELECT level FROM level_v JOIN tax_closure ON descendant = rn AND ancestor = 2 AND dist > 0)
  SELECT h.hog_id, h.level FROM hog_v h JOIN lv USING (level)""")
def subhogs_below_level(s: Spark, sf: str) -> DataFrame:
    lv = D.levels(s, sf).select("level", F.col("rn").cast("bigint").alias("taxid"))
    below = lv.join(hierarchy.subtree(_closure(s, sf), 2).where("dist > 0"), "taxid", "left_semi")
    return D.hog(s, sf).join(below, "level", "left_semi").select("hog_id", "level")


@R.query("SELECT descendant, ancestor, dist FROM tax_closure")
def tax_closure(s: Spark, sf: str) -> DataFrame:
    return _closure(s, sf)


@R.query("SELECT ancestor AS taxid, dist FROM tax_closure WHERE descendant = (SELECT min(taxid) FROM genome_v)")
def lineage(s: Spark, sf: str) -> DataFrame:
    return hierarchy.lineage(_closure(s, sf), D.genome(s, sf).agg(F.min("taxid")).first()[0])


@R.query("SELECT e.entry_nr, e.hog_id FROM entry_v e JOIN tax_closure c ON c.descendant = e.taxid AND c.ancestor = 3 WHERE e.hog_id <> ''")
def subtree_members(s: Spark, sf: str) -> DataFrame:
    clade = hierarchy.subtree(_closure(s, sf), 3).select("taxid")
    return D.entry(s, sf).where("hog_id <> ''").join(clade, "taxid", "left_semi").select("entry_nr", "hog_id")


@R.query("SELECT taxid FROM tax_v WHERE taxid NOT IN (SELECT parent_taxid FROM tax_v)")
def taxonomy_leaves(s: Spark, sf: str) -> DataFrame:
    return hierarchy.leaves(D.taxonomy(s, sf))


@R.query("""WITH m AS (SELECT CAST(taxid AS BIGINT) AS taxid FROM genome_v UNION SELECT CAST(rn AS BIGINT) FROM level_v WHERE rn % 5 = 1),
  n AS (SELECT c.descendant, min(c.dist) AS d FROM tax_closure c JOIN m ON m.taxid = c.ancestor WHERE c.dist > 0 GROUP BY 1)
  SELECT m.taxid, c.ancestor AS parent_taxid FROM m LEFT JOIN n ON n.descendant = m.taxid LEFT JOIN tax_closure c ON c.descendant = m.taxid AND c.dist = n.d""")
def induced_taxonomy(s: Spark, sf: str) -> DataFrame:
    """Tree over all genomes and every fifth clade."""
    some = D.levels(s, sf).where("rn % 5 = 1").select(F.col("rn").cast("bigint").alias("taxid"))
    return hierarchy.induced_tree(_closure(s, sf), D.genome(s, sf).select(F.col("taxid").cast("bigint")).unionByName(some))


@R.query("""SELECT taxid, shared, row_number() OVER (ORDER BY shared DESC, path) - 1 AS rank FROM (
  SELECT g.taxid::BIGINT AS taxid, (SELECT count(*) FROM tax_closure c WHERE c.descendant = g.taxid AND c.ancestor IN (SELECT ancestor FROM tax_closure WHERE descendant = (SELECT min(taxid) FROM genome_v))) AS shared,
    (SELECT list(c.ancestor ORDER BY c.dist DESC) FROM tax_closure c WHERE c.descendant = g.taxid) AS path FROM genome_v g)""")
def species_ordering(s: Spark, sf: str) -> DataFrame:
    g = D.genome(s, sf)
    return hierarchy.species_order(_closure(s, sf), g.select(F.col("taxid").cast("bigint")), g.agg(F.min("taxid")).first()[0])


@R.query("""WITH l AS (SELECT CAST(taxid AS BIGINT) AS taxid, row_number() OVER (ORDER BY taxid) - 1 AS i FROM genome_v)
  SELECT ancestor, min(i) AS first, max(i) AS last, count(*) AS size FROM tax_closure JOIN l ON l.taxid = descendant GROUP BY 1""")
def clade_leaf_ranges(s: Spark, sf: str) -> DataFrame:
    idx = D.genome(s, sf).select(F.col("taxid").cast("bigint"), (F.row_number().over(Window.orderBy("taxid")) - 1).alias("idx"))
    return hierarchy.leaf_ranges(_closure(s, sf), idx)


QUERIES, ORACLE = R.queries, R.sql
