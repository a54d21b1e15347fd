"""Queries through the release object and single lookups: entries, ranges, groups, trees, orders, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.api import Release
from phylolake.functions import hogid, strings
from phylolake.operators import annotations, graphops, groups, hierarchy, idmap, ontology, relations, scans, search, sequences, similarity, summary, synteny
from phylolake.operators.textindex import TextIndex
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import once, shared_dir, table
from phylolake.sinks import writers
from phylolake.sources import text

R = Registry(D.VIEWS)
Spark = SparkSession


def release(s: Spark, sf: str) -> Release:
    """The newest release of the tables as one object."""
    tables = {
        "genome": D.genome(s, sf), "taxonomy": D.taxonomy(s, sf).where("parent_taxid <> 0 OR taxid = 1"), "entry": D.entry(s, sf), "pairwise": D.pair(s, sf), "hog_level": D.hog(s, sf), "xref": D.xref(s, sf),
        "go_annotation": D.go(s, sf), "go_term": D.term(s, sf), "go_edge": D.go_edge(s, sf).withColumn("relation", F.lit("is_a")), "domain": D.domain(s, sf),
        "sequence": D.sequence(s, sf).select(F.col("seq_id").alias("entry_nr"), "seq", F.lit("").alias("cdna"), F.lit("").alias("description")),
    }
    return Release(s, tables=tables)


_FIRST_ENTRY = "(SELECT min(entry_nr) FROM entry_v WHERE fam IS NOT NULL)"
_FIRST_CODE = "(SELECT min(species_code) FROM entry_v)"
_TOP_FAM = "(SELECT fam FROM entry_v WHERE fam IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fam LIMIT 1)"


def _first_entry(s, sf) -> int:
    return D.entry(s, sf).where("fam IS NOT NULL").agg(F.min("entry_nr")).first()[0] or 0


def _first_code(s, sf) -> str:
    return D.entry(s, sf).agg(F.min("species_code")).first()[0]


# -- scans and lookups ------------------------------------------------------------------


@R.query(f"SELECT entry_nr, species_code, hog_id, fam FROM entry_v WHERE entry_nr = {_FIRST_ENTRY}")
def entry_lookup(s: Spark, sf: str) -> DataFrame:
    """One entry by number, as the release object gives it."""
    row = release(s, sf).entry(_first_entry(s, sf)).row
    return s.createDataFrame([(row.entry_nr, row.species_code, row.hog_id, row.fam)], "entry_nr bigint, species_code string, hog_id string, fam bigint")


@R.query(f"SELECT entry_nr, hog_id, locus_start FROM entry_v WHERE species_code = {_FIRST_CODE}")
def proteins_of_genome(s: Spark, sf: str) -> DataFrame:
    return release(s, sf).proteins_of(_first_code(s, sf)).select("entry_nr", "hog_id", "locus_start")


@R.query("SELECT * FROM genome_v")
def genome_table(s: Spark, sf: str) -> DataFrame:
    return release(s, sf).table("genome")


@R.query("SELECT entry_nr, locus_start FROM entry_v WHERE locus_start BETWEEN 1000 AND 50000 AND strand = 1")
def read_where_bound(s: Spark, sf: str) -> DataFrame:
    """A condition with bound parameters, and a projection."""
    return scans.read_where(D.entry(s, sf).select("entry_nr", "locus_start", "strand"), "locus_start BETWEEN :low AND :high AND strand = :strand", {"low": 1000, "high": 50000, "strand": 1}).drop("strand")


@R.query("SELECT hog_id, count(*) AS n FROM entry_v WHERE hog_id >= 'HOG:E000' AND hog_id < 'HOG:E001' GROUP BY 1")
def lexicographic_prefix(s: Spark, sf: str) -> DataFrame:
    low, high = hogid.lexicographic_range("HOG:E000")
    return D.entry(s, sf).where((F.col("hog_id") >= low) & (F.col("hog_id") < high)).groupBy("hog_id").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT entry_nr FROM entry_v WHERE alt_splice = (SELECT min(alt_splice) FROM entry_v WHERE alt_splice > 0) OR entry_nr = (SELECT min(alt_splice) FROM entry_v WHERE alt_splice > 0)")
def isoforms_of_main(s: Spark, sf: str) -> DataFrame:
    """All isoforms of the first gene with several."""
    main = D.entry(s, sf).where("alt_splice > 0").agg(F.min("alt_splice")).first()[0] or 0
    e = D.entry(s, sf)
    return e.where((F.col("alt_splice") == main) | (F.col("entry_nr") == main)).select("entry_nr")


@R.query("SELECT x.* FROM xref_v x WHERE x.entry_nr IN (SELECT entry_nr FROM main_v)")
def xrefs_of_main_isoforms(s: Spark, sf: str) -> DataFrame:
    """The range of the wanted entries goes to the scan, the set itself is the residual."""
    return annotations.filter_entries(D.xref(s, sf), D.main(s, sf).select("entry_nr"))


@R.query("SELECT source, count(*) AS n FROM xref_v GROUP BY 1")
def xref_value_counts(s: Spark, sf: str) -> DataFrame:
    x = D.xref(s, sf)
    sources = [r[0] for r in x.select("source").distinct().collect()]  # the codes of an enum
    return s.createDataFrame([(v, scans.count_values(x, "source", v)) for v in sources], "source int, n bigint")


@R.query("SELECT entry_nr // 1000 AS part, count(*) AS n, min(entry_nr) AS low, max(entry_nr) AS high FROM entry_v GROUP BY 1")
def entries_in_parts(s: Spark, sf: str) -> DataFrame:
    """Counts over parts of a thousand numbers, from a chunked pass over the sorted entries."""
    part = D.entry(s, sf).groupBy(F.floor(F.col("entry_nr") / 1000).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("entry_nr").alias("low"), F.max("entry_nr").alias("high"))
    rows = [tuple(r) for chunk in scans.chunks(part.orderBy("part"), 500) for r in chunk]
    return s.createDataFrame(rows, "part bigint, n bigint, low bigint, high bigint")


# -- ids ----------------------------------------------------------------------------------


@R.query("""SELECT DISTINCT OmaHOG AS raw, try_cast(nullif(regexp_extract(OmaHOG, '^\\s*HOG:[A-Za-z]*0*([0-9]+)', 1), '') AS BIGINT) AS fam, regexp_replace(regexp_replace(trim(OmaHOG), '_-?[0-9]+$', ''), '^(HOG:[A-Za-z]*)0+([0-9])', '\\1\\2') AS plain,
  CAST(len(string_split(trim(OmaHOG), '.')) - 1 AS INT) AS depth FROM entry WHERE OmaHOG LIKE '%HOG:%'""")
def hog_id_parts(s: Spark, sf: str) -> DataFrame:
    """Every spelling of a group id with its family, plain spelling and depth."""
    h = table(s, sf, "entry").where("OmaHOG LIKE '%HOG:%'").select(F.col("OmaHOG").alias("raw")).distinct()
    return h.select("raw", hogid.strict_family_nr("raw").alias("fam"), hogid.plain_id("raw").alias("plain"), hogid.depth(F.trim("raw")).alias("depth"))


_PAIR_IDS = "pi AS (SELECT DISTINCT a.hog_id AS h1, b.hog_id AS h2 FROM pair_v p JOIN entry_v a ON a.entry_nr = p.entry_nr1 JOIN entry_v b ON b.entry_nr = p.entry_nr2 WHERE a.hog_id <> '' AND b.hog_id <> '')"


def _pair_ids(s, sf) -> DataFrame:
    e = D.entry(s, sf).where("hog_id <> ''").select("entry_nr", "hog_id")
    return D.pair(s, sf).join(e.toDF("entry_nr1", "h1"), "entry_nr1").join(e.toDF("entry_nr2", "h2"), "entry_nr2").select("h1", "h2").distinct()


@R.query(f"""WITH {_PAIR_IDS}, c AS (SELECT h1, h2, coalesce(list_filter(range(1, least(length(h1), length(h2)) + 1), lambda i: substr(h1, i, 1) <> substr(h2, i, 1))[1] - 1, least(length(h1), length(h2))) AS n FROM pi)
  SELECT h1, h2, substr(h1, 1, CAST(n AS BIGINT)) AS prefix, contains(substr(h1, 1, CAST(n AS BIGINT)), '.') AND regexp_matches(substr(h1, 1, CAST(n AS BIGINT)), '[0-9]$') AS paralogs FROM c""")
def character_paralogs(s: Spark, sf: str) -> DataFrame:
    """The older, character-based paralog test on the ids of all related entries."""
    return _pair_ids(s, sf).select("h1", "h2", hogid.common_prefix("h1", "h2").alias("prefix"), hogid.character_paralogs("h1", "h2").alias("paralogs"))


@R.query("""SELECT xref_id, CASE WHEN regexp_matches(xref_id, '^ENS[A-Z]{0,3}G[0-9]{11}$') THEN 'Ensembl Gene' WHEN regexp_matches(xref_id, '^ENS[A-Z]{0,3}P[0-9]{11}$') THEN 'Ensembl Protein' WHEN regexp_matches(xref_id, '^ENS[A-Z]{0,3}T[0-9]{11}$') THEN 'Ensembl Transcript'
  WHEN regexp_matches(xref_id, '^FB[gnptr]{2}[0-9]{7}$') THEN 'FlyBase' WHEN regexp_matches(xref_id, '^[A-Z]{3}[0-9]{5}\\.[0-9]$') THEN 'NCBI' WHEN regexp_matches(xref_id, '^WBGene[0-9]{8}$') THEN 'WormBase' ELSE 'n/a' END AS form FROM (SELECT DISTINCT xref_id FROM xref_v)""")
def id_forms(s: Spark, sf: str) -> DataFrame:
    return D.xref(s, sf).select("xref_id").distinct().select("xref_id", text.source_of_id(F.col("xref_id"), F.lit("n/a")).alias("form"))


@R.query("""SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders""")
def any_date(s: Spark, sf: str) -> DataFrame:
    """Dates written in the formats of release files, one format per row, and read back."""
    n = len(strings.DATE_FORMATS)
    o = table(s, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("t"))
    written = F.coalesce(*[F.when(F.col("k") % n == i, F.date_format("t", f)) for i, f in enumerate(strings.DATE_FORMATS)])
    return o.select("k", strings.any_date(written).alias("d"))


@R.query("""WITH n AS (SELECT taxid, sci_name, list_min(list_filter([instr(sci_name, '('), instr(sci_name, 'serogroup'), instr(sci_name, 'serotype'), instr(sci_name, 'serovar'), instr(sci_name, 'biotype'), instr(sci_name, 'subsp'), instr(sci_name, 'pv.'), instr(sci_name, 'bv.'), CASE WHEN starts_with(sci_name, 'Escherichia coli') THEN instr(sci_name, 'O') ELSE 0 END, length(sci_name) + 1], lambda x: x > 0)) AS p FROM genome_v)
  SELECT taxid, trim(substr(sci_name, 1, p - 1)) AS species, substr(sci_name, p) AS strain FROM n""")
def species_and_strain(s: Spark, sf: str) -> DataFrame:
    return D.genome(s, sf).select("taxid", strings.species_part("sci_name").alias("species"), strings.strain_part("sci_name").alias("strain"))


@R.query("""SELECT entry_nr, string_agg(xref_id, '; ' ORDER BY xref_id) AS ids FROM (SELECT DISTINCT entry_nr, xref_id FROM xref_v) WHERE NOT contains(xref_id, ';') GROUP BY 1""")
def id_lists(s: Spark, sf: str) -> DataFrame:
    """Lists of ids joined, taken apart and joined again."""
    joined = D.xref(s, sf).where("NOT contains(xref_id, ';')").groupBy("entry_nr").agg(F.array_join(F.array_sort(F.collect_set("xref_id")), "; ").alias("t"))
    return joined.select("entry_nr", F.array_join(strings.id_list("t"), "; ").alias("ids"))


# -- relations and groups -------------------------------------------------------------------


@R.query("SELECT entry_nr2, rel_type FROM pair_v WHERE entry_nr1 = (SELECT min(entry_nr1) FROM pair_v) AND rel_type <= 3")
def orthologs_of_entry(s: Spark, sf: str) -> DataFrame:
    p = D.pair(s, sf)
    return release(s, sf).orthologs(p.agg(F.min("entry_nr1")).first()[0] or 0).select("entry_nr2", "rel_type")


@R.query(f"""WITH q AS (SELECT * FROM entry_v WHERE entry_nr = {_FIRST_ENTRY}), t AS (SELECT e.entry_nr, e.species_code, q.species_code AS own, string_split(q.hog_id, '.') AS t1, string_split(e.hog_id, '.') AS t2 FROM entry_v e JOIN q ON q.fam = e.fam WHERE e.hog_id <> ''),
  d AS (SELECT *, list_filter(range(1, CAST(least(len(t1), len(t2)) AS BIGINT) + 1), lambda i: t1[i] <> t2[i])[1] AS i FROM t), o AS (SELECT *, i IS NULL OR (i > 1 AND regexp_extract(t1[i], '^([0-9]+)', 1) <> regexp_extract(t2[i], '^([0-9]+)', 1)) AS ok FROM d),
  pa AS (SELECT * FROM o WHERE ok AND species_code <> own), mine AS (SELECT t2 AS m, count(*) AS c FROM t WHERE species_code = own GROUP BY 1),
  l AS (SELECT p.entry_nr, sum(c) AS n FROM pa p, mine WHERE coalesce((SELECT x.i IS NULL OR (x.i > 1 AND regexp_extract(m[x.i], '^([0-9]+)', 1) <> regexp_extract(p.t2[x.i], '^([0-9]+)', 1)) FROM (SELECT list_filter(range(1, CAST(least(len(m), len(p.t2)) AS BIGINT) + 1), lambda j: m[j] <> p.t2[j])[1] AS i) x), true) GROUP BY 1)
  SELECT p.entry_nr, p.species_code, CASE WHEN l.n > 1 THEN 'm' ELSE '1' END || ':' || CASE WHEN count(*) OVER (PARTITION BY p.species_code) > 1 THEN 'n' ELSE '1' END AS rel_label FROM pa p JOIN l ON l.entry_nr = p.entry_nr""")
def induced_cardinality(s: Spark, sf: str) -> DataFrame:
    """Induced orthologs of one entry with their cardinality."""
    return relations.induced_cardinality(D.entry(s, sf), _first_entry(s, sf))


@R.query("""WITH i AS (SELECT entry_nr, min(xref_id) AS id FROM xref_v WHERE source = 95 GROUP BY 1) SELECT a.species_code AS genome1, b.species_code AS genome2, p.entry_nr1, p.entry_nr2, CASE rel_type WHEN 0 THEN '1:1' WHEN 1 THEN '1:n' WHEN 2 THEN 'm:1' WHEN 3 THEN 'm:n' WHEN 4 THEN 'close paralog' WHEN 5 THEN 'homeolog' ELSE 'n/a' END AS rel_label, x.id AS id1, y.id AS id2
  FROM pair_v p JOIN entry_v a ON a.entry_nr = p.entry_nr1 JOIN entry_v b ON b.entry_nr = p.entry_nr2 LEFT JOIN i x ON x.entry_nr = p.entry_nr1 LEFT JOIN i y ON y.entry_nr = p.entry_nr2 WHERE a.species_code < b.species_code""")
def pair_export(s: Spark, sf: str) -> DataFrame:
    """Relations of all pairs of genomes with source ids, as exported to one file per pair."""
    ids = D.xref(s, sf).where("source = 95").groupBy("entry_nr").agg(F.min("xref_id").alias("id"))
    return relations.pair_export(D.pair(s, sf), D.entry(s, sf), D.genome(s, sf), ids)


@R.query("SELECT a.species_code AS genome1, b.species_code AS genome2 FROM genome_v a JOIN genome_v b ON a.species_code < b.species_code")
def genome_pairs(s: Spark, sf: str) -> DataFrame:
    return relations.genome_pairs(D.genome(s, sf))


@R.query("""WITH h AS (SELECT DISTINCT entry_nr FROM go_v g WHERE term_nr IN (SELECT term_nr FROM go_v GROUP BY 1 ORDER BY count(*) DESC, term_nr LIMIT 1)) SELECT group_nr, count(*) AS n FROM entry_v WHERE group_nr <> 0 AND entry_nr IN (SELECT entry_nr FROM h) GROUP BY 1 ORDER BY n DESC, group_nr LIMIT 10""")
def top_groups_of_hits(s: Spark, sf: str) -> DataFrame:
    """The ten flat groups with most entries among those annotated with the most used term."""
    g = D.go(s, sf)
    top = g.groupBy("term_nr").count().orderBy(F.desc("count"), "term_nr").first()
    return groups.top_groups(D.entry(s, sf), g.where(F.col("term_nr") == (top[0] if top else 0)))


@R.query("""WITH x AS (SELECT lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')) AS n FROM xref_v) SELECT 'prefix' AS mode, count(*) AS n FROM x WHERE starts_with(n, 'tq') UNION ALL SELECT 'suffix', count(*) FROM x WHERE contains(n, '1a') UNION ALL SELECT 'exact', count(*) FROM x WHERE n = 'tq0012a'""")
def xref_hit_counts(s: Spark, sf: str) -> DataFrame:
    x = D.xref(s, sf)
    return s.createDataFrame([(m, idmap.count(x, q, m)) for m, q in (("prefix", "TQ"), ("suffix", "1A"), ("exact", "TQ0012A"))], "mode string, n bigint")


@R.query("SELECT coalesce(a.entry_nr, b.entry_nr, c.entry_nr) AS entry_nr, a.x AS uniprot, b.x AS refseq, c.x AS source_id FROM (SELECT entry_nr, min(xref_id) AS x FROM xref_v WHERE source = 10 GROUP BY 1) a FULL JOIN (SELECT entry_nr, min(xref_id) AS x FROM xref_v WHERE source = 40 GROUP BY 1) b ON a.entry_nr = b.entry_nr FULL JOIN (SELECT entry_nr, min(xref_id) AS x FROM xref_v WHERE source = 95 GROUP BY 1) c ON c.entry_nr = coalesce(a.entry_nr, b.entry_nr)")
def ids_of_every_kind(s: Spark, sf: str) -> DataFrame:
    return idmap.joined_ids(D.xref(s, sf), {"uniprot": 10, "refseq": 40, "source_id": 95})


@R.query("""SELECT g.entry_nr, g.term_nr, e.pid AS protein_id, x.xref_id FROM go_v g LEFT JOIN (SELECT entry_nr, species_code || CASE WHEN entry_nr - entry_off < 100000 THEN lpad(CAST(entry_nr - entry_off AS VARCHAR), 5, '0') ELSE CAST(entry_nr - entry_off AS VARCHAR) END AS pid FROM entry_v JOIN genome_v USING (species_code)) e ON e.entry_nr = g.entry_nr
  LEFT JOIN (SELECT entry_nr, min(xref_id) AS xref_id FROM xref_v WHERE source = 10 GROUP BY 1) x ON x.entry_nr = g.entry_nr""")
def annotations_with_ids(s: Spark, sf: str) -> DataFrame:
    """Annotations with the computed protein id and a cross-reference, where there are any."""
    e = D.entry(s, sf).join(D.genome(s, sf).select("species_code", "entry_off"), "species_code").select("entry_nr", strings.protein_id("species_code", F.col("entry_nr") - F.col("entry_off")).alias("protein_id"))
    x = D.xref(s, sf).where("source = 10").groupBy("entry_nr").agg(F.min("xref_id").alias("xref_id"))
    return D.go(s, sf).select("entry_nr", "term_nr", "evidence", "reference").join(e, "entry_nr", "left").join(x, "entry_nr", "left").select("entry_nr", "term_nr", "protein_id", "xref_id")


@R.query("SELECT p.entry_nr1, p.entry_nr2, coalesce(n.score, -1) AS score FROM pair_v p LEFT JOIN (SELECT entry_nr1, entry_nr2, score FROM pair_v WHERE rel_type = 0) n USING (entry_nr1, entry_nr2)")
def replaced_scores(s: Spark, sf: str) -> DataFrame:
    """A column replaced by new values of some rows, one to one, and by a default elsewhere."""
    p = D.pair(s, sf)
    return writers.replace_column(p, p.where("rel_type = 0").select("entry_nr1", "entry_nr2", "score"), ["entry_nr1", "entry_nr2"], "score", -1.0).select("entry_nr1", "entry_nr2", "score")


@R.query("SELECT DISTINCT e.entry_nr, d.domain_id, d.dom_start || ':' || d.dom_end AS coords FROM (SELECT DISTINCT e.md5, d.domain_id, d.dom_start, d.dom_end FROM domain_v d JOIN entry_v e ON e.entry_nr = d.entry_nr WHERE e.md5 <> '') d JOIN entry_v e ON e.md5 = d.md5")
def domains_by_md5(s: Spark, sf: str) -> DataFrame:
    """Domains delivered by sequence md5, given to every entry with that sequence."""
    e = D.entry(s, sf).where("md5 <> ''").select("entry_nr", "md5")
    rows = D.domain(s, sf).join(e, "entry_nr").select("md5", "domain_id", F.concat_ws(":", "dom_start", "dom_end").alias("coords"))
    return text.inserted_domains(rows, e).distinct()


@R.query("SELECT DISTINCT domain_id FROM domain_v WHERE regexp_matches(domain_id, '^PF') OR regexp_matches(domain_id, '^[1-4]\\.')")
def known_domains(s: Spark, sf: str) -> DataFrame:
    return D.domain(s, sf).where(text.is_known_domain()).select("domain_id").distinct()


# -- trees ------------------------------------------------------------------------------------


@R.query("SELECT taxid, name FROM tax_v WHERE parent_taxid = 2 AND taxid <> 2")
def children_of_taxon(s: Spark, sf: str) -> DataFrame:
    return hierarchy.children(D.taxonomy(s, sf), 2).select("taxid", "name")


@R.query("SELECT c.descendant AS term_nr, c.ancestor, c.dist FROM go_closure c WHERE c.descendant IN (SELECT max(term_nr) FROM term_v)")
def superterms(s: Spark, sf: str) -> DataFrame:
    """The last term with all its superterms."""
    last = D.term(s, sf).agg(F.max("term_nr").alias("term_nr"))
    return ontology.superterms(D.go_tree(s, sf), last)


@R.query("SELECT entry_nr, term_nr, evidence IN ('EXP','IDA','IPI','IMP','IGI','IEP') AS experimental, evidence IN ('EXP','IDA','IPI','IMP','IGI','IEP') OR (evidence = 'IEA' AND reference IN ('GO_REF:0000002','GO_REF:0000003','GO_REF:0000004','GO_REF:0000037','GO_REF:0000038','GO_REF:0000023','GO_REF:0000039','GO_REF:0000040')) AS trusted FROM go_v")
def trusted_annotations(s: Spark, sf: str) -> DataFrame:
    g = D.go(s, sf)
    return g.where(ontology.not_negated(F.lit(""))).select("entry_nr", "term_nr", ontology.is_experimental(F.col("evidence")).alias("experimental"), ontology.is_trusted(F.col("evidence"), F.col("reference")).alias("trusted"))


@R.query("""WITH a AS (SELECT ancestor AS clade, descendant AS species FROM tax_closure JOIN genome_v ON taxid = descendant), n AS (SELECT clade, count(DISTINCT species) AS n FROM a GROUP BY 1), j AS (SELECT x.clade AS c1, y.clade AS c2, count(*) AS k FROM a x JOIN a y ON x.species = y.species GROUP BY 1, 2),
  d AS (SELECT c1, c2, 2.0::DOUBLE * k / (p.n + q.n) AS dice FROM j JOIN n p ON p.clade = c1 JOIN n q ON q.clade = c2) SELECT c1 AS clade1, round(max(dice), 9) AS dice FROM d GROUP BY 1""")
def clade_match(s: Spark, sf: str) -> DataFrame:
    """Every clade matched to the one with the most similar set of species."""
    names = D.taxonomy(s, sf).select(F.col("taxid").alias("clade"), "name")
    species = D.tax_tree(s, sf).join(D.genome(s, sf).select(F.col("taxid").cast("bigint").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("clade"), F.col("descendant").alias("species"))
    a = species.join(names, "clade")
    return similarity.clade_map(a, a).select("clade1", F.round("dice", 9).alias("dice"))


# -- gene order ----------------------------------------------------------------------------------

_ORDER = "go_ AS (SELECT *, lead(hog_id) OVER (PARTITION BY species_code, chromosome ORDER BY locus_start, entry_nr) AS nx FROM main_v WHERE hog_id <> '')"
_CUT = "array_to_string(list_slice(string_split({0}, '.'), 1, {1}), '.')"


def _edges(s, sf) -> DataFrame:
    return synteny.adjacent_edges(D.main(s, sf).where("hog_id <> ''"), "hog_id").select("node1", "node2", "weight")


def _parents(s, sf, depth: int) -> DataFrame:
    """Groups cut to ``depth`` + 1 steps with the groups one step above."""
    h = D.main(s, sf).where("hog_id <> ''").select("hog_id").distinct()
    cut = lambda n: F.array_join(F.slice(hogid.tokens("hog_id"), 1, n), ".")
    return h.select((F.col("hog_id") if depth == 1 else cut(depth + 1)).alias("node"), cut(depth).alias("parent")).distinct()


_LIFTED = f"""e1 AS (SELECT least({_CUT.format('hog_id', 2)}, {_CUT.format('nx', 2)}) AS node1, greatest({_CUT.format('hog_id', 2)}, {_CUT.format('nx', 2)}) AS node2 FROM go_ WHERE nx IS NOT NULL),
  e0 AS (SELECT least({_CUT.format('hog_id', 1)}, {_CUT.format('nx', 1)}) AS node1, greatest({_CUT.format('hog_id', 1)}, {_CUT.format('nx', 1)}) AS node2 FROM go_ WHERE nx IS NOT NULL),
  ed AS (SELECT 1 AS depth, node1, node2, count(*) AS weight FROM e1 WHERE node1 <> node2 GROUP BY ALL UNION ALL SELECT 0, node1, node2, count(*) FROM e0 WHERE node1 <> node2 GROUP BY ALL)"""


@R.query(f"WITH {_ORDER}, {_LIFTED} SELECT depth, node1, node2, weight FROM ed")
def ancestral_synteny(s: Spark, sf: str) -> DataFrame:
    """Adjacency of genes propagated to the groups of one step and to the families."""
    h = D.main(s, sf).where("hog_id <> ''").select("hog_id").distinct()
    cut = lambda n: F.array_join(F.slice(hogid.tokens("hog_id"), 1, n), ".")
    below = h.select(F.col("hog_id").alias("node"), cut(2).alias("parent"))
    above = h.select(cut(2).alias("node"), cut(1).alias("parent")).distinct()
    out = synteny.propagate_edges(_edges(s, sf), [above, below]).where("depth < 2")
    return out.select("depth", "node1", "node2", F.col("weight").cast("bigint").alias("weight"))


@R.query(f"""WITH {_ORDER}, {_LIFTED}, r AS (SELECT hog_id, min(rn) AS row_nr FROM (SELECT hog_id, row_number() OVER (ORDER BY hog_id) - 1 AS rn FROM (SELECT DISTINCT hog_id FROM hog_v)) GROUP BY 1)
  SELECT a.row_nr AS row1, b.row_nr AS row2, weight FROM ed JOIN r a ON a.hog_id = node1 JOIN r b ON b.hog_id = node2 WHERE depth = 0""")
def synteny_rows(s: Spark, sf: str) -> DataFrame:
    """Family adjacency between the row numbers of the groups."""
    h = D.hog(s, sf).select("hog_id").distinct().withColumn("level", F.lit(""))
    rows = groups.level_index(h).select("hog_id", F.col("idx_per_level").cast("bigint").alias("row_nr"))
    return synteny.edges_to_rows(ancestral_synteny(s, sf).where("depth = 0"), rows)


@R.query(f"WITH {_ORDER}, {_LIFTED}, t AS (SELECT min(node1) AS n FROM ed WHERE depth = 0) SELECT CASE WHEN node1 = n THEN node2 ELSE node1 END AS node, weight FROM ed, t WHERE depth = 0 AND (node1 = n OR node2 = n)")
def neighbour_families(s: Spark, sf: str) -> DataFrame:
    e = ancestral_synteny(s, sf).where("depth = 0")
    return synteny.direct_neighbours(e, e.agg(F.min("node1")).first()[0])


@R.query("""WITH RECURSIVE b AS (SELECT entry_nr1 AS x, entry_nr2 AS y FROM pair_v UNION SELECT entry_nr2, entry_nr1 FROM pair_v), c AS (SELECT DISTINCT x AS node, x AS reached FROM b UNION SELECT c.node, b.y FROM c JOIN b ON b.x = c.reached)
  SELECT node, min(reached) AS component FROM c GROUP BY 1""")
def relation_components(s: Spark, sf: str) -> DataFrame:
    """Connected pieces of all relations."""
    return graphops.component_labels(D.pair(s, sf), "entry_nr1", "entry_nr2")


# -- search ------------------------------------------------------------------------------------------


@R.query("SELECT seq_id, length(seq) AS n FROM seq_v WHERE contains(seq, 'FAMILY')")
def sequence_containment(s: Spark, sf: str) -> DataFrame:
    return sequences.exact_search(D.sequence(s, sf), "FAMILY").select("seq_id", F.length("seq").cast("bigint").alias("n"))


def document_index(s: Spark, sf: str) -> TextIndex:
    """The stored index of the documents' texts, written once per session."""
    index = TextIndex(f"{shared_dir(s)}/phylolake-{s.sparkContext.applicationId}/text-index-{abs(hash(sf))}", n=4, buckets=16)

    def make():
        index.build(table(s, sf, "documents").select("doc_id", "text"), "doc_id", "text")
        out = index.table(s)
        out._phylolake_path = index.path
        return out

    once(s, f"document_index {sf}", make)
    return index


@R.query("SELECT doc_id FROM documents WHERE contains(lower(text), 'orthologs of')")
def indexed_substring(s: Spark, sf: str) -> DataFrame:
    """Documents with a phrase, through the stored index of letter n-grams."""
    return document_index(s, sf).find(table(s, sf, "documents").select("doc_id", "text"), "doc_id", "text", "Orthologs of").select("doc_id")


@R.query("SELECT gram, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(['gene', 'fami', 'prot']) AS gram, lower(text) AS t FROM documents) WHERE contains(t, gram) GROUP BY 1")
def indexed_words(s: Spark, sf: str) -> DataFrame:
    wanted = s.createDataFrame([("gene",), ("fami",), ("prot",)], "gram string")
    return document_index(s, sf).words(s, wanted).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def _token_entries(s, sf, token) -> DataFrame:
    return token.search(search.Corpus(entries=D.entry(s, sf), xrefs=D.xref(s, sf), hogs=D.hog(s, sf), domains=D.domain(s, sf), sequences=None)).entries.distinct()


@R.query("SELECT entry_nr FROM entry_v WHERE group_nr = (SELECT group_nr FROM entry_v WHERE group_nr <> 0 GROUP BY 1 ORDER BY count(*) DESC, group_nr LIMIT 1)")
def token_group(s: Spark, sf: str) -> DataFrame:
    top = D.entry(s, sf).where("group_nr <> 0").groupBy("group_nr").count().orderBy(F.desc("count"), "group_nr").first()
    return _token_entries(s, sf, search.GroupToken(str(top[0] if top else 0)))


@R.query("SELECT DISTINCT entry_nr FROM domain_v WHERE domain_id = 'PF00007'")
def token_domain(s: Spark, sf: str) -> DataFrame:
    return _token_entries(s, sf, search.DomainToken("PF00007"))


@R.query("""WITH x AS (SELECT entry_nr, lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')) AS n FROM xref_v) SELECT DISTINCT entry_nr FROM x WHERE CASE WHEN EXISTS (SELECT 1 FROM x WHERE starts_with(n, 'tq')) THEN starts_with(n, 'tq') ELSE contains(n, 'tq') END""")
def token_xref(s: Spark, sf: str) -> DataFrame:
    return _token_entries(s, sf, search.XRefToken("TQ"))


# -- checks and exports --------------------------------------------------------------------------------


@R.query("SELECT entry_nr FROM (SELECT entry_nr, locus_start, lag(locus_start) OVER (ORDER BY entry_nr) AS b FROM entry_v) WHERE locus_start < b")
def row_order_breaks(s: Spark, sf: str) -> DataFrame:
    return summary.row_order_breaks(D.entry(s, sf).select("entry_nr", "locus_start"), "entry_nr", "locus_start").select("entry_nr")


@R.query("""WITH a AS (SELECT TermNr AS term_nr, CAST(sum(coalesce(Counts, 0)) AS BIGINT) AS n FROM go_term_counts WHERE TermNr IS NOT NULL GROUP BY 1), b AS (SELECT term_nr, count(DISTINCT entry_nr) AS n FROM go_v GROUP BY 1)
  SELECT coalesce(a.term_nr, b.term_nr) AS term_nr, a.n AS stored, b.n AS fresh FROM a FULL JOIN b ON a.term_nr = b.term_nr WHERE a.n IS DISTINCT FROM b.n""")
def stored_differs(s: Spark, sf: str) -> DataFrame:
    """Terms whose stored count is not that of the release."""
    a = table(s, sf, "go_term_counts").where("TermNr IS NOT NULL").groupBy(F.col("TermNr").alias("term_nr")).agg(F.sum(F.coalesce("Counts", F.lit(0))).alias("n"))
    b = D.go(s, sf).groupBy("term_nr").agg(F.countDistinct("entry_nr").alias("n"))
    return summary.stored_differs(a, b, ["term_nr"], ["n"]).select("term_nr", F.col("stored.n").alias("stored"), F.col("fresh.n").alias("fresh"))


@R.query("SELECT seq_id FROM seq_v WHERE length(seq) % 3 <> 0")
def genetic_code_mismatch(s: Spark, sf: str) -> DataFrame:
    """Sequences whose length does not fit three letters a residue."""
    q = D.sequence(s, sf).select("seq_id", F.col("seq").alias("cdna"), F.expr("left(seq, CAST(floor(length(seq) / 3) AS INT))").alias("protein"))
    return summary.genetic_code_mismatch(q, "cdna", "protein").select("seq_id")


@R.query("""SELECT CAST(entry_nr AS VARCHAR) AS object_id, '<Link><LinkId>' || entry_nr || '</LinkId><ProviderId>1</ProviderId><ObjectSelector><Database>Protein</Database><ObjectList><Query>' || replace(replace(replace(xref_id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</Query></ObjectList></ObjectSelector><ObjectUrl><Base>http://x/</Base><Rule>&lo.id;</Rule></ObjectUrl></Link>' AS xml FROM xref_v WHERE source = 40""")
def linkout_records(s: Spark, sf: str) -> DataFrame:
    links = D.xref(s, sf).where("source = 40").select(F.col("entry_nr").cast("string").alias("object_id"), F.col("xref_id").alias("query"), F.lit(None).cast("string").alias("url_part"))
    return writers.linkout_records(links, provider="1", base_url="http://x/", database="Protein")


@R.query("SELECT round(avg(c), 6) AS mean, count(*) AS n FROM (SELECT least(sum(dom_end - dom_start + 1) / 400.0::DOUBLE, 1.0) AS c FROM domain_v GROUP BY entry_nr) WHERE c > 0")
def domain_coverage_mean(s: Spark, sf: str) -> DataFrame:
    """Mean share of the proteins inside domains, of proteins with any."""
    c = annotations.coverage(D.domain(s, sf)).withColumn("c", F.least(F.col("covered").cast("double") / 400.0, F.lit(1.0))).where("c > 0")
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@R.query("""WITH b AS (SELECT old_id, new_id, row_number() OVER (PARTITION BY old_id ORDER BY jaccard DESC, new_id) AS rn FROM (SELECT DISTINCT old_id, new_id, jaccard FROM fm)) SELECT old_id, new_id FROM b WHERE rn = 1""", name="hog_forwarded")
def hog_forwarded(s: Spark, sf: str) -> DataFrame:
    """Where every group of the release before went: its best successor."""
    from phylolake.plans.similarity_queries import hog_map

    best = hog_map(s, sf).groupBy("old_id").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "new_id")).alias("b"))
    return best.select("old_id", "b.new_id")


def _forward_sql() -> str:
    from phylolake.plans.similarity_queries import ORACLE

    return f"WITH fm AS ({ORACLE['hog_map']}), b AS (SELECT old_id, new_id, row_number() OVER (PARTITION BY old_id ORDER BY jaccard DESC, new_id) AS rn FROM fm) SELECT old_id, new_id FROM b WHERE rn = 1"


R.sql["hog_forwarded"] = _forward_sql()


@R.query("""WITH s AS (SELECT DISTINCT fam, species_code AS x FROM entry_v WHERE fam IS NOT NULL), n AS (SELECT fam, count(*) AS n FROM s GROUP BY 1), j AS (SELECT a.fam AS q, b.fam AS f, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.fam <> b.fam WHERE a.fam % 50 = 0 GROUP BY 1, 2)
  SELECT q AS query, f AS fam, round(k / (x.n + y.n - k)::DOUBLE, 9) AS jaccard FROM j JOIN n x ON x.fam = q JOIN n y ON y.fam = f WHERE k / (x.n + y.n - k)::DOUBLE >= 0.7""")
def lsh_similar_families(s: Spark, sf: str) -> DataFrame:
    """Families with nearly the species of every fiftieth one, by a stored index of minhash bands."""
    sets = D.entry(s, sf).where("fam IS NOT NULL").select("fam", F.col("species_code").alias("x")).distinct()
    index = similarity.lsh_add(sets, "fam", "x")
    out = similarity.lsh_query(index, index.where("fam % 50 = 0"), "fam", threshold=0.7)
    return out.select("query", "fam", F.round("jaccard", 9).alias("jaccard"))


QUERIES, ORACLE = R.queries, R.sql
