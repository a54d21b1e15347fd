"""Queries on ontology terms, annotations, domains and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import strings
from phylolake.operators import annotations as A
from phylolake.operators import enrichment as EN
from phylolake.operators import ontology
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import table

R = Registry(D.VIEWS)
Spark = SparkSession


def _closure(s: Spark, sf: str) -> DataFrame:
    return D.go_tree(s, sf)


def _go(s: Spark, sf: str) -> DataFrame:
    return A.without_obsolete(D.go(s, sf), D.term(s, sf))


_GO = "gv AS (SELECT g.* FROM go_v g WHERE term_nr IN (SELECT term_nr FROM term_v))"


@R.query("SELECT descendant, ancestor, dist FROM go_closure")
def go_closure(s: Spark, sf: str) -> DataFrame:
    return _closure(s, sf)


@R.query("""SELECT descendant AS term_nr, min(dist) AS depth FROM go_closure WHERE ancestor NOT IN (SELECT child FROM go_edge) GROUP BY 1""")
def go_min_depth(s: Spark, sf: str) -> DataFrame:
    return ontology.min_depths(_closure(s, sf), D.go_edge(s, sf))


@R.query("SELECT ancestor AS term_nr, descendant, dist FROM go_closure WHERE ancestor = (SELECT term_nr FROM term_n WHERE rn = 2) AND dist <= 3")
def go_subterms(s: Spark, sf: str) -> DataFrame:
    second = [r[0] for r in D.term(s, sf).select("term_nr").orderBy("term_nr").limit(2).collect()][1:]
    return ontology.subterms(_closure(s, sf), s.createDataFrame([(x,) for x in second], "term_nr bigint"), max_steps=3)


_FREQ = """k AS (SELECT g.term_nr, t.aspect, count(DISTINCT g.entry_nr) AS k FROM go_v g JOIN term_v t ON t.term_nr = g.term_nr GROUP BY 1, 2),
  tot AS (SELECT aspect, CAST(sum(k) AS BIGINT) AS total FROM k GROUP BY 1), up AS (SELECT c.ancestor AS term_nr, CAST(sum(k) AS BIGINT) AS n FROM k JOIN go_closure c ON c.descendant = k.term_nr GROUP BY 1),
  fr AS (SELECT t.term_nr, t.aspect, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(n::DOUBLE / nullif(total, 0), 0) AS freq FROM term_v t LEFT JOIN up ON up.term_nr = t.term_nr LEFT JOIN tot ON tot.aspect = t.aspect)"""


def _freq(s: Spark, sf: str) -> DataFrame:
    return ontology.term_frequencies(_go(s, sf), _closure(s, sf), D.term(s, sf))


@R.query(f"WITH {_FREQ} SELECT term_nr, aspect, n, total, round(freq, 9) AS freq, CASE WHEN freq > 0 THEN round(abs(ln(freq)), 6) END AS ic FROM fr")
def go_term_frequency(s: Spark, sf: str) -> DataFrame:
    return _freq(s, sf).select("term_nr", "aspect", "n", "total", F.round("freq", 9).alias("freq"), F.round(ontology.information_content(F.col("freq")), 6).alias("ic"))


@R.query(f"""WITH {_FREQ}, p AS (SELECT a.term_nr AS t1, b.term_nr AS t2 FROM term_n a JOIN term_n b ON b.rn = a.rn + 7),
  l AS (SELECT t1, t2, lca, fa FROM (SELECT p.t1, p.t2, x.ancestor AS lca, f.freq AS fa, row_number() OVER (PARTITION BY p.t1, p.t2 ORDER BY f.freq, x.ancestor) AS rn FROM p JOIN go_closure x ON x.descendant = p.t1 JOIN go_closure y ON y.descendant = p.t2 AND y.ancestor = x.ancestor JOIN fr f ON f.term_nr = x.ancestor) WHERE rn = 1),
  j AS (SELECT p.t1, p.t2, lca, fa, a.aspect = b.aspect AND lca IS NOT NULL AS ok, a.freq AS f1, b.freq AS f2 FROM p JOIN fr a ON a.term_nr = p.t1 JOIN fr b ON b.term_nr = p.t2 LEFT JOIN l ON l.t1 = p.t1 AND l.t2 = p.t2),
  r AS (SELECT *, CASE WHEN NOT ok THEN 0.0 WHEN f1 <= 0 OR f2 <= 0 THEN NULL WHEN ln(f1) + ln(f2) = 0 THEN 1.0 ELSE 2 * ln(fa) / (ln(f1) + ln(f2)) END AS lin FROM j)
  SELECT t1, t2, lca, round(lin, 6) AS lin, round(CASE WHEN NOT ok THEN 0.0 ELSE (1 - fa) * lin END, 6) AS similarity FROM r""")
def go_lin(s: Spark, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = D.term(s, sf).select("term_nr", F.row_number().over(Window.orderBy("term_nr")).alias("rn"))
    pairs = n.select(F.col("term_nr").alias("t1"), (F.col("rn") + 7).alias("rn")).join(n.withColumnRenamed("term_nr", "t2"), "rn").select("t1", "t2")
    out = ontology.pair_similarity(pairs, _closure(s, sf), _freq(s, sf))
    return out.select("t1", "t2", "lca", F.round("lin", 6).alias("lin"), F.round("similarity", 6).alias("similarity"))


@R.query(f"""WITH {_GO} SELECT DISTINCT entry_nr, term_nr FROM gv a WHERE NOT EXISTS (SELECT 1 FROM gv b JOIN go_closure c ON c.descendant = b.term_nr AND c.dist > 0 WHERE b.entry_nr = a.entry_nr AND c.ancestor = a.term_nr)""")
def go_most_specific(s: Spark, sf: str) -> DataFrame:
    return ontology.most_specific(_go(s, sf), _closure(s, sf))


_EXP = "('EXP','IDA','IEP','IGI','IMP','IPI')"
_STRONG = "('EXP','IDA','IPI','IMP','IGI','IEP','HTP','HDA','HMP','HGI','HEP')"


@R.query(f"""WITH p AS (SELECT entry_nr, term_nr, max((evidence IN {_EXP})::INT) AS x, max((evidence <> 'IEA' AND evidence NOT IN {_EXP})::INT) AS c, max((evidence = 'IEA')::INT) AS e FROM go_v GROUP BY 1, 2), a AS (SELECT entry_nr, count(*) AS n, sum(x) AS x, sum(c) AS c, sum(e) AS e FROM p GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS annotations, CAST(sum(x) AS BIGINT) AS experimental, CAST(sum(c) AS BIGINT) AS curated, CAST(sum(e) AS BIGINT) AS electronic, count(*) AS proteins, count(*) FILTER (WHERE group_nr <> 0) AS proteins_in_group, count(*) FILTER (WHERE hog_id <> '') AS proteins_in_hog FROM a JOIN entry_v USING (entry_nr)""")
def evidence_summary(s: Spark, sf: str) -> DataFrame:
    return A.evidence_summary(D.go(s, sf), D.entry(s, sf))


@R.query(f"""SELECT species_code, n_exp, n_cur, row_number() OVER (ORDER BY n_exp DESC, n_cur DESC, species_code) - 1 AS priority FROM (SELECT e.species_code, count(*) FILTER (WHERE evidence IN {_STRONG}) AS n_exp,
  count(*) FILTER (WHERE evidence <> 'IEA' AND evidence NOT IN {_STRONG}) AS n_cur FROM entry_v e LEFT JOIN go_v g ON g.entry_nr = e.entry_nr GROUP BY 1)""")
def genome_importance(s: Spark, sf: str) -> DataFrame:
    return A.genome_importance(D.go(s, sf), D.entry(s, sf))


@R.query("""SELECT 'LAKE' AS DB, e.species_code || CASE WHEN e.entry_nr - e.entry_off < 100000 THEN lpad(CAST(e.entry_nr - e.entry_off AS VARCHAR), 5, '0') ELSE CAST(e.entry_nr - e.entry_off AS VARCHAR) END AS DB_Object_ID, DB_Object_ID AS DB_Object_Symbol, '' AS Qualifier, 'GO:' || CASE WHEN g.term_nr < 10000000 THEN lpad(CAST(g.term_nr AS VARCHAR), 7, '0') ELSE CAST(g.term_nr AS VARCHAR) END AS GO_ID, g.reference AS DB_Reference, g.evidence AS Evidence, '' AS "With",
  coalesce(CASE t.aspect WHEN 'biological_process' THEN 'P' WHEN 'molecular_function' THEN 'F' WHEN 'cellular_component' THEN 'C' END, '') AS Aspect, '' AS DB_Object_Name, '' AS Synonym, 'protein' AS DB_Object_Type, 'taxon:' || e.taxid AS Taxon_ID, '20240101' AS Date, 'LAKE' AS Assigned_By, '' AS Annotation_Extension, '' AS Gene_Product_Form_ID
  FROM go_v g JOIN term_v t ON t.term_nr = g.term_nr JOIN (SELECT v.*, gv.entry_off FROM entry_v v JOIN genome_v gv USING (species_code)) e ON e.entry_nr = g.entry_nr""")
def gaf_export(s: Spark, sf: str) -> DataFrame:
    off = D.genome(s, sf).select("species_code", "entry_off")
    e = D.entry(s, sf).join(off, "species_code").withColumn("protein_id", strings.protein_id("species_code", F.col("entry_nr") - F.col("entry_off")))
    return A.to_gaf(D.go(s, sf), e, D.term(s, sf), db="LAKE", date="20240101")


@R.query("""WITH t AS (SELECT term_nr FROM go_v GROUP BY 1 ORDER BY count(*) DESC, term_nr LIMIT 1) SELECT DISTINCT g.entry_nr FROM go_v g JOIN t USING (term_nr) JOIN main_v m ON m.entry_nr = g.entry_nr""")
def entries_with_term(s: Spark, sf: str) -> DataFrame:
    """Main isoforms annotated with the most used term."""
    g = D.go(s, sf)
    top = g.groupBy("term_nr").count().orderBy(F.desc("count"), "term_nr").first()[0]
    return A.entries_with(g, "term_nr", top, allowed=D.main(s, sf))


@R.query("SELECT term_nr, count(*) AS n_rows, count(DISTINCT entry_nr) AS n_entries FROM go_v GROUP BY 1")
def annotation_counts(s: Spark, sf: str) -> DataFrame:
    return D.go(s, sf).groupBy("term_nr").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entry_nr").alias("n_entries"))


@R.query("SELECT species_code, string_agg(DISTINCT evidence, ';' ORDER BY evidence) AS evidences FROM go_v g JOIN entry_v e ON e.entry_nr = g.entry_nr GROUP BY 1")
def evidence_per_genome(s: Spark, sf: str) -> DataFrame:
    j = D.go(s, sf).join(D.entry(s, sf).select("entry_nr", "species_code"), "entry_nr")
    return j.groupBy("species_code").agg(F.array_join(F.array_sort(F.collect_set("evidence")), ";").alias("evidences"))


@R.query("SELECT entry_nr, CAST(sum(dom_end - dom_start + 1) AS BIGINT) AS covered FROM domain_v GROUP BY 1")
def domain_coverage(s: Spark, sf: str) -> DataFrame:
    return A.coverage(D.domain(s, sf))


@R.query("""SELECT bin, n, (bin + 1) / 50.0::DOUBLE AS upper FROM (SELECT CAST(least(floor(covered / 400.0::DOUBLE * 50), 49) AS INT) AS bin, count(*) AS n
  FROM (SELECT sum(dom_end - dom_start + 1) AS covered FROM domain_v GROUP BY entry_nr) WHERE covered > 0 GROUP BY 1)""")
def domain_coverage_hist(s: Spark, sf: str) -> DataFrame:
    return A.histogram(A.coverage(D.domain(s, sf)).withColumn("share", F.col("covered").cast("double") / 400.0), "share")


_ARCH = """a AS (SELECT d.entry_nr, string_agg(domain_id, ',' ORDER BY dom_start, domain_id) AS arch FROM domain_v d GROUP BY 1),
  c AS (SELECT e.fam, a.arch, count(*) AS n, min(a.entry_nr) AS representative FROM a JOIN entry_v e ON e.entry_nr = a.entry_nr WHERE fam IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT fam, count(*) AS fam_size FROM entry_v WHERE fam IS NOT NULL GROUP BY 1),
  ar AS (SELECT fam, arch, n, representative, fam_size FROM (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY n DESC, arch) AS rn FROM c) JOIN s USING (fam) WHERE rn = 1 AND fam_size > 2 AND n > 0)"""


def _arch(s: Spark, sf: str) -> DataFrame:
    return A.prevalent_architectures(D.domain(s, sf), D.entry(s, sf), min_count=0)


@R.query(f"WITH {_ARCH} SELECT * FROM ar")
def domain_arch_prevalence(s: Spark, sf: str) -> DataFrame:
    return _arch(s, sf)


@R.query(f"""WITH {_ARCH}, d AS (SELECT fam, n, fam_size, d, count(*) AS c FROM (SELECT fam, n, fam_size, unnest(string_split(arch, ',')) AS d FROM ar) GROUP BY 1, 2, 3, 4), q AS (SELECT * FROM d WHERE fam = (SELECT min(fam) FROM ar))
  SELECT d.fam, CAST(sum(least(d.c, q.c)) AS BIGINT) AS overlap, round(d.n * 100.0::DOUBLE / d.fam_size, 4) AS prevalence FROM d JOIN q ON q.d = d.d WHERE d.fam <> q.fam GROUP BY d.fam, d.n, d.fam_size""")
def similar_families(s: Spark, sf: str) -> DataFrame:
    a = _arch(s, sf)
    return A.similar_families(a, a.agg(F.min("fam")).first()[0])


_STUDY = "st AS (SELECT DISTINCT e.entry_nr FROM entry_v e WHERE e.fam = (SELECT fam FROM entry_v WHERE fam IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fam LIMIT 1))"


@R.query(f"""WITH {_GO}, {_STUDY}, a AS (SELECT DISTINCT entry_nr, term_nr FROM gv), ms AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b JOIN go_closure c ON c.descendant = b.term_nr AND c.dist > 0 WHERE b.entry_nr = a.entry_nr AND c.ancestor = a.term_nr)),
  sp AS (SELECT DISTINCT m.entry_nr, c.ancestor AS term_nr FROM ms m JOIN go_closure c ON c.descendant = m.term_nr WHERE c.ancestor IN (SELECT term_nr FROM a)),
  pop AS (SELECT DISTINCT entry_nr FROM a), ch AS (SELECT entry_nr FROM st WHERE entry_nr IN (SELECT entry_nr FROM pop)),
  ct AS (SELECT term_nr, count(*) FILTER (WHERE entry_nr IN (SELECT entry_nr FROM ch)) AS a, count(*) AS k, (SELECT count(*) FROM ch) AS n, (SELECT count(*) FROM pop) AS t FROM sp GROUP BY 1),
  x AS (SELECT ct.*, unnest(range(a, least(n, k) + 1)) AS x FROM ct WHERE a > 0),
  l AS (SELECT term_nr, a, k, n, t, least(1.0, sum(exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(t - k + 1) - lgamma(n - x + 1) - lgamma(t - k - n + x + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)))) AS p FROM x WHERE t - k - n + x >= 0 GROUP BY ALL)
  SELECT term_nr, a AS study_count, n AS study_n, k AS pop_count, t AS pop_n, round((a / n) / (k / t), 6) AS fold_change, round(p, 8) AS p FROM l""")
def enrichment(s: Spark, sf: str) -> DataFrame:
    """Terms over-represented in the largest family."""
    e = D.entry(s, sf)
    fam = e.where("fam IS NOT NULL").groupBy("fam").count().orderBy(F.desc("count"), "fam").first()[0]
    out = EN.enrichment(_go(s, sf), e.where(F.col("fam") == fam), _closure(s, sf))
    return out.select("term_nr", "study_count", "study_n", "pop_count", "pop_n", F.round("fold_change", 6).alias("fold_change"), F.round("p", 8).alias("p"))


@R.query("""WITH t AS (SELECT term_nr, (1 + (term_nr * 37) % 1000) / 1000.0::DOUBLE AS p FROM term_v), r AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM t)
  SELECT term_nr, p, least(p * m, 1.0) AS p_bonferroni, round(least(min(p * m / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0), 9) AS p_fdr FROM r""")
def multiple_testing(s: Spark, sf: str) -> DataFrame:
    t = D.term(s, sf).select("term_nr", ((1 + (F.col("term_nr") * 37) % 1000) / F.lit(1000.0)).alias("p"))
    return EN.corrected(t).withColumn("p_fdr", F.round("p_fdr", 9))


@R.query("""SELECT TermNr AS term_nr, CAST(sum(coalesce(Counts, 0)) AS BIGINT) AS stored, (SELECT count(DISTINCT entry_nr) FROM go_v g WHERE g.term_nr = c.TermNr) AS fresh FROM go_term_counts c WHERE TermNr IS NOT NULL GROUP BY 1""")
def stored_term_counts_check(s: Spark, sf: str) -> DataFrame:
    """Stored counts beside those of the release."""
    c = table(s, sf, "go_term_counts").where("TermNr IS NOT NULL").groupBy(F.col("TermNr").alias("term_nr")).agg(F.sum(F.coalesce("Counts", F.lit(0))).alias("stored"))
    f = D.go(s, sf).groupBy("term_nr").agg(F.countDistinct("entry_nr").alias("fresh"))
    return c.join(f, "term_nr", "left").select("term_nr", "stored", F.coalesce("fresh", F.lit(0)).alias("fresh"))


QUERIES, ORACLE = R.queries, R.sql
