"""Queries on identifiers, text search and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import sequence, strings
from phylolake.operators import idmap, search, sequences, words
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import table

R = Registry(D.VIEWS)
Spark = SparkSession


@R.query("SELECT entry_nr, source, xref_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_nr ORDER BY source, xref_id) AS rn FROM xref_v) WHERE rn = 1")
def best_xref_per_entry(s: Spark, sf: str) -> DataFrame:
    return idmap.best_per_entry(D.xref(s, sf))


@R.query("""SELECT e.entry_nr, coalesce(x.xref_id, '') AS canonical_id FROM entry_v e LEFT JOIN (SELECT entry_nr, xref_id, row_number() OVER (PARTITION BY entry_nr ORDER BY list_position([0, 10, 25, 20, 60, 65, 70, 40, 95], source), xref_id) AS rn
  FROM xref_v WHERE verification <= 2 AND source IN (0, 10, 25, 20, 60, 65, 70, 40, 95)) x ON x.entry_nr = e.entry_nr AND rn = 1""")
def canonical_xref(s: Spark, sf: str) -> DataFrame:
    return idmap.canonical(D.xref(s, sf), D.entry(s, sf), [idmap.SOURCES[x] for x in idmap.CANONICAL_ORDER])


_RED = """rd AS (SELECT gene, xref, entry_nr, source, verification FROM (SELECT CASE WHEN e.alt_splice = 0 THEN e.entry_nr ELSE e.alt_splice END AS gene, lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')) AS xref, x.entry_nr, source, verification,
  row_number() OVER (PARTITION BY CASE WHEN e.alt_splice = 0 THEN e.entry_nr ELSE e.alt_splice END, lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')) ORDER BY verification, CASE WHEN x.entry_nr = (CASE WHEN e.alt_splice = 0 THEN e.entry_nr ELSE e.alt_splice END) THEN 0 ELSE 1 END, source, x.entry_nr) AS rn
  FROM xref_v x JOIN entry_v e ON e.entry_nr = x.entry_nr) WHERE rn = 1)"""


@R.query(f"WITH {_RED} SELECT * FROM rd")
def xref_reduce(s: Spark, sf: str) -> DataFrame:
    return idmap.reduce_xrefs(D.xref(s, sf), D.entry(s, sf))


@R.query(f"WITH {_RED} SELECT xref, count(*) AS n FROM rd GROUP BY 1 HAVING count(*) >= 2")
def frequent_gene_names(s: Spark, sf: str) -> DataFrame:
    return idmap.frequent_names(idmap.reduce_xrefs(D.xref(s, sf), D.entry(s, sf)), list(idmap.SOURCES.values()), 2)


@R.query("""SELECT entry_nr, coalesce(string_agg(DISTINCT xref_id, ' _|_ ' ORDER BY xref_id) FILTER (WHERE source = 10), '') AS s10, coalesce(string_agg(DISTINCT xref_id, ' _|_ ' ORDER BY xref_id) FILTER (WHERE source = 95), '') AS s95,
  coalesce(string_agg(DISTINCT xref_id, ' _|_ ' ORDER BY xref_id) FILTER (WHERE source = 110), '') AS s110 FROM xref_v WHERE source IN (10, 95, 110) GROUP BY 1""")
def xref_pivot(s: Spark, sf: str) -> DataFrame:
    return idmap.pivot_sources(D.xref(s, sf), [10, 95, 110])


@R.query("SELECT e.species_code, x.source, count(*) AS n FROM xref_v x JOIN entry_v e ON e.entry_nr = x.entry_nr GROUP BY 1, 2")
def xrefs_per_species(s: Spark, sf: str) -> DataFrame:
    j = D.xref(s, sf).join(D.entry(s, sf).select("entry_nr", "species_code"), "entry_nr")
    return j.groupBy("species_code", "source").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH t AS (SELECT x.entry_nr, max((source IN (0, 10, 40, 50, 25, 20))::INT) AS trusted FROM xref_v x GROUP BY 1)
  SELECT count(*) FILTER (WHERE trusted = 1) AS proteins, count(*) FILTER (WHERE trusted = 1 AND group_nr <> 0) AS in_group, count(*) FILTER (WHERE trusted = 1 AND hog_id <> '') AS in_hog FROM t JOIN entry_v e ON e.entry_nr = t.entry_nr""")
def trusted_xref_summary(s: Spark, sf: str) -> DataFrame:
    return idmap.xref_summary(D.xref(s, sf), D.entry(s, sf))


@R.query("""WITH x AS (SELECT *, lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')) AS n FROM xref_v)
  SELECT 'exact' AS mode, entry_nr, source, xref_id FROM x WHERE n = 'tq0012a' OR lower(xref_id) = 'tq0012a' UNION ALL SELECT 'prefix', entry_nr, source, xref_id FROM x WHERE starts_with(n, 'tq00') UNION ALL SELECT 'suffix', entry_nr, source, xref_id FROM x WHERE contains(n, '12a')""")
def xref_search_modes(s: Spark, sf: str) -> DataFrame:
    x = D.xref(s, sf)
    parts = [idmap.search(x, q, m).select(F.lit(m).alias("mode"), "entry_nr", "source", "xref_id") for q, m in (("TQ0012A", "exact"), ("tq00", "prefix"), ("12A", "suffix"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("SELECT entry_nr, xref_id, CASE WHEN source IN (0, 10) THEN 'http://uniprot.org/uniprot/' || xref_id WHEN source = 50 THEN 'http://www.ncbi.nlm.nih.gov/gene/' || xref_id ELSE 'http://ensembl.org/id/' || xref_id END AS url FROM xref_v WHERE source IN (0, 10, 20, 25, 50)")
def linkout_urls(s: Spark, sf: str) -> DataFrame:
    return idmap.mapper("linkout").rows(D.xref(s, sf)).select("entry_nr", "xref_id", "url")


@R.query("SELECT x.* FROM xref_v x WHERE verification <= 2 AND source IN (110, 0, 10, 105, 95)")
def gene_names(s: Spark, sf: str) -> DataFrame:
    """Gene names and symbols of all entries."""
    return idmap.mapper("gene_name_or_symbol").rows(idmap.xrefs_of(D.xref(s, sf)))


@R.query("""SELECT entry_nr, source, xref_id FROM (SELECT entry_nr, source, min(xref_id) AS xref_id FROM xref_v GROUP BY 1, 2)""")
def nested_xrefs(s: Spark, sf: str) -> DataFrame:
    """Every id of the nested maps (entry, source code, first id)."""
    return idmap.nested(D.xref(s, sf)).select("entry_nr", F.explode("ids").alias("source", "xref_id"))


@R.query("""SELECT entry_nr, source, xref_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_nr ORDER BY list_position([110, 0, 10, 105, 95], source), xref_id) AS rn FROM xref_v WHERE verification <= 2 AND source IN (110, 0, 10, 105, 95)) WHERE rn = 1""")
def best_gene_name(s: Spark, sf: str) -> DataFrame:
    """The best gene name of every entry: the mapper's own order of sources decides."""
    return idmap.mapper("gene_name_or_symbol").best(D.xref(s, sf))


@R.query("""SELECT entry_nr, source, xref_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_nr ORDER BY list_position([110, 0, 10, 25, 40, 50, 95], source), xref_id) AS rn FROM xref_v WHERE verification <= 2 AND source IN (110, 0, 10, 25, 40, 50, 95)) WHERE rn = 1""")
def best_name_or_main_id(s: Spark, sf: str) -> DataFrame:
    return idmap.mapper("gene_name_and_main").best(D.xref(s, sf))


@R.query("SELECT * FROM xref_v WHERE source IN (0, 10)")
def uniprot_ids(s: Spark, sf: str) -> DataFrame:
    """UniProt ids of every verification, modified ones too."""
    return idmap.mapper("uniprot").rows(D.xref(s, sf))


@R.query("SELECT * FROM xref_v WHERE verification <= 2")
def exact_or_unchecked_ids(s: Spark, sf: str) -> DataFrame:
    return idmap.mapper("no_approximate").rows(D.xref(s, sf))


@R.query("""WITH q AS (SELECT DISTINCT left(sci_name, len(sci_name) - 2) AS query FROM genome_v WHERE len(sci_name) > 2), t AS (SELECT taxid, sci_name FROM genome_v WHERE sci_name <> '')
  SELECT query, taxid, round(max(1 - levenshtein(lower(query), lower(sci_name)) / greatest(len(query), len(sci_name))::DOUBLE), 6) AS score FROM q, t WHERE 1 - levenshtein(lower(query), lower(sci_name)) / greatest(len(query), len(sci_name))::DOUBLE >= 0.6 GROUP BY 1, 2""")
def fuzzy_genome_match(s: Spark, sf: str) -> DataFrame:
    g = D.genome(s, sf)
    q = g.where(F.length("sci_name") > 2).select(F.expr("left(sci_name, length(sci_name) - 2)").alias("q"))
    return idmap.fuzzy_match(q, g, "q", "sci_name", key="taxid").select("query", "taxid", F.round("score", 6).alias("score"))


def _corpus(s: Spark, sf: str) -> search.Corpus:
    tax = D.taxonomy(s, sf)
    return search.Corpus(
        entries=D.entry(s, sf), xrefs=D.xref(s, sf), hogs=D.hog(s, sf), go=D.go(s, sf), domains=D.domain(s, sf), genomes=D.genome(s, sf), taxonomy=tax,
        tree=D.tax_tree(s, sf), term_tree=D.go_tree(s, sf),
    )


@R.query("""WITH clade AS (SELECT rn FROM level_v WHERE rn = 2), f AS (SELECT hog_id FROM entry_v WHERE fam IS NOT NULL AND NOT contains(hog_id, '.') GROUP BY 1 ORDER BY count(*) DESC, hog_id LIMIT 1)
  SELECT e.entry_nr FROM entry_v e JOIN tax_closure c ON c.descendant = e.taxid AND c.ancestor = 2 JOIN f ON e.hog_id = f.hog_id OR starts_with(e.hog_id, f.hog_id || '.')
  WHERE e.entry_nr IN (SELECT g.entry_nr FROM go_v g JOIN go_closure x ON x.descendant = g.term_nr WHERE x.ancestor = (SELECT term_nr FROM term_n WHERE rn = 1))""")
def combined_search(s: Spark, sf: str) -> DataFrame:
    """Entries of a clade, in the largest family, annotated below the most general term."""
    c = _corpus(s, sf)
    name = D.levels(s, sf).where("rn = 2").first()["level"]
    fam = c.entries.where("fam IS NOT NULL AND NOT contains(hog_id, '.')").groupBy("hog_id").count().orderBy(F.desc("count"), "hog_id").first()[0]
    term = D.term(s, sf).agg(F.min("term_nr")).first()[0]
    return search.combined_search(c, [search.HogToken(fam), search.TaxToken(name), search.GOToken(str(term))]).entries


@R.query("""WITH x AS (SELECT DISTINCT entry_nr FROM xref_v WHERE contains(lower(regexp_replace(xref_id, '\\.[0-9]{1,2}$', '')), '12')) SELECT entry_nr, 'xref' AS source FROM x UNION SELECT entry_nr, 'number' FROM entry_v WHERE entry_nr = 12""")
def protein_text_search(s: Spark, sf: str) -> DataFrame:
    return search.search_protein(search.Corpus(entries=D.entry(s, sf), xrefs=D.xref(s, sf)), "12")


@R.query("""SELECT e.entry_nr, e.species_code || CASE WHEN e.entry_nr - g.entry_off < 100000 THEN lpad(CAST(e.entry_nr - g.entry_off AS VARCHAR), 5, '0') ELSE CAST(e.entry_nr - g.entry_off AS VARCHAR) END AS protein_id, e.species_code AS code, e.entry_nr - g.entry_off AS local_nr FROM entry_v e JOIN genome_v g USING (species_code)""")
def protein_id_codec(s: Spark, sf: str) -> DataFrame:
    e = D.entry(s, sf).join(D.genome(s, sf).select("species_code", "entry_off"), "species_code")
    out = e.select("entry_nr", strings.protein_id("species_code", F.col("entry_nr") - F.col("entry_off")).alias("protein_id"))
    code, nr = strings.protein_id_parts("protein_id")
    return out.select("entry_nr", "protein_id", code.alias("code"), nr.alias("local_nr"))


@R.query("SELECT seq_id, seq FROM seq_v")
def sequence_sanitise(s: Spark, sf: str) -> DataFrame:
    return D.sequence(s, sf)


@R.query("""SELECT seq_id, length(seq) AS len, md5(seq) AS md5, round(coalesce((length(regexp_replace(seq, '[^GC]', '', 'g')))::DOUBLE / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0), 0), 9) AS gc,
  (seq <> '' AND NOT regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWXY]'))::INT AS valid FROM seq_v""")
def sequence_properties(s: Spark, sf: str) -> DataFrame:
    return D.sequence(s, sf).select(
        "seq_id", F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("md5"), F.round(sequence.gc_content("seq"), 9).alias("gc"), sequence.is_valid("seq").cast("int").alias("valid")
    )


@R.query("SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'orthologs', ''))) // 9 AS occurrences FROM documents WHERE contains(lower(text), 'orthologs')")
def substring_occurrences(s: Spark, sf: str) -> DataFrame:
    return sequences.substring_rows(table(s, sf, "documents"), "text", "Orthologs").select("doc_id", F.col("occurrences").cast("bigint").alias("occurrences"))


def _queries(s: Spark, sf: str) -> DataFrame:
    return D.sequence(s, sf).where("seq_id % 50 = 0 AND length(seq) >= 6").select(F.col("seq_id").alias("query_id"), F.col("seq").alias("query"))


@R.query("""WITH q AS (SELECT seq_id AS query_id, seq AS query FROM seq_v WHERE seq_id % 50 = 0 AND length(seq) >= 6),
  w AS (SELECT query_id, substr(query, i, 6) AS kmer, count(*) AS w FROM (SELECT query_id, query, unnest(range(1, length(query) - 4)) AS i FROM q) GROUP BY 1, 2),
  ix AS (SELECT DISTINCT seq_id, substr(seq, i, 6) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM seq_v WHERE length(seq) >= 6)),
  h AS (SELECT query_id, seq_id, CAST(sum(w) AS BIGINT) AS hits FROM w JOIN ix USING (kmer) GROUP BY 1, 2)
  SELECT query_id, seq_id, hits, round(hits / (length(query) - 5)::DOUBLE, 9) AS coverage FROM h JOIN q USING (query_id) WHERE hits / (length(query) - 5)::DOUBLE >= 0.3::DOUBLE""")
def kmer_rank(s: Spark, sf: str) -> DataFrame:
    """Every fiftieth sequence, in its whole length, ranked against all sequences by shared words of six letters."""
    out = words.shared_words(_queries(s, sf), D.sequence(s, sf), coverage=0.3)
    return out.withColumn("coverage", F.round("coverage", 9))


@R.query()
def local_alignment(s: Spark, sf: str) -> DataFrame:
    """The best five sequences of every fiftieth one, aligned in whole length."""
    return sequences.approximate_search(_queries(s, sf), D.sequence(s, sf), n=5, coverage=0.2)


@R.query()
def closest_sequence(s: Spark, sf: str) -> DataFrame:
    """The closest sequence of every fiftieth one, searched in whole length."""
    return sequences.closest_sequences(_queries(s, sf), D.sequence(s, sf))


@R.query("""SELECT seq_id, kmer, CAST(list_aggregate(list_transform([1, 2, 3, 4], lambda i: CAST((instr('ACDEFGHIKLMNPQRSTVWXY', substr(kmer, i, 1)) - 1) * pow(21, 4 - i) AS BIGINT)), 'sum') AS BIGINT) AS code
  FROM (SELECT DISTINCT seq_id, substr(seq, i, 4) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seq_v WHERE length(seq) >= 4))""")
def kmer_codec(s: Spark, sf: str) -> DataFrame:
    """Every distinct word of four letters of every sequence, coded and decoded."""
    coded = sequences.kmer_index(D.sequence(s, sf), k=4).withColumn("code", sequence.kmer_code("kmer"))
    return coded.where(sequence.kmer_word("code", 4) == F.col("kmer")).select("seq_id", "kmer", "code")


@R.query("""SELECT taxid, sci_name, lower(regexp_replace(regexp_replace(species_code, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, replace(sci_name, ' ', '_') AS label FROM genome_v""")
def genome_labels(s: Spark, sf: str) -> DataFrame:
    return D.genome(s, sf).select("taxid", "sci_name", strings.snake_case("species_code").alias("snake"), strings.newick_label("sci_name").alias("label"))


QUERIES, ORACLE = R.queries, R.sql
