"""Readers of line-oriented release files; each gives a DataFrame of the release schema.

Compressed files are read by Spark's codecs; an empty file gives an empty table.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import strings
from phylolake.operators.relations import reversed_label, type_code

PAIR_SCHEMA = "nr1 bigint, nr2 bigint, score double, rel string, overlap double, distance double"


def pairs_tsv(spark: SparkSession, path, *, offset1: Column | int = 0, offset2: Column | int = 0, swap: bool = False, score_scale: float = 100.0) -> DataFrame:
    """Relations from tab-separated files of local numbers: (entry_nr1, entry_nr2, rel_type, score, overlap, distance).

    Offsets turn local into global numbers; scores are divided by ``score_scale``; ``swap``
    exchanges the ends and turns the relation type around. Lines with a # are comments.
    """
    raw = spark.read.csv(path, sep="\t", schema=PAIR_SCHEMA, comment="#", enforceSchema=True)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _relations(raw, F.col("nr1") + lit(offset1), F.col("nr2") + lit(offset2), swap, score_scale)


def _ends(a: Column, b: Column, swap: bool, score_scale: float) -> list[Column]:
    rel = F.when(F.col("rel") == "n:1", "m:1").when(F.col("rel") == "1:m", "1:n").when(F.col("rel").isin("n:m", "n:n", "m:m"), "m:n").otherwise(F.col("rel"))
    return [
        (b if swap else a).alias("entry_nr1"), (a if swap else b).alias("entry_nr2"), type_code(reversed_label(rel) if swap else rel).alias("rel_type"),
        (F.col("score") / score_scale).alias("score"), F.col("overlap"), F.col("distance"),
    ]


def _relations(raw: DataFrame, a: Column, b: Column, swap: bool, score_scale: float) -> DataFrame:
    return raw.where("nr1 IS NOT NULL AND nr2 IS NOT NULL").select(*_ends(a, b, swap, score_scale))


def _between_genomes(raw: DataFrame, genomes: DataFrame, both_ways: bool, score_scale: float) -> DataFrame:
    """Relations of lines with the names (g1, g2) of their genomes, by one pass over the lines."""
    off = F.broadcast(genomes.select("species_code", "entry_off"))
    j = raw.where("nr1 IS NOT NULL AND nr2 IS NOT NULL").join(off.toDF("g1", "o1"), "g1").join(off.toDF("g2", "o2"), "g2")
    a, b = F.col("nr1") + F.col("o1"), F.col("nr2") + F.col("o2")
    ways = F.array(*[F.struct(*_ends(a, b, swap, score_scale)) for swap in (False, True)[: 1 + both_ways]])
    return j.select(F.explode(ways).alias("r")).select("r.*")


def pair_files(
    spark: SparkSession, paths: list[str], genomes: DataFrame, *, pattern: str = r"([A-Z0-9]{5})-([A-Z0-9]{5})\.[^/]*$", both_ways: bool = False, score_scale: float = 100.0
) -> DataFrame:
    """Relations of many genome-pair files in one scan; the genomes come from the file names.

    ``genomes`` (species_code, entry_off) is a dimension; its offsets make the numbers global. The types are spelled as for
    :func:`pairs_tsv`; ``both_ways`` gives every relation from its other end too.
    """
    name = F.input_file_name()
    raw = spark.read.csv(paths, sep="\t", schema=PAIR_SCHEMA, comment="#").select("*", F.regexp_extract(name, pattern, 1).alias("g1"), F.regexp_extract(name, pattern, 2).alias("g2"))
    return _between_genomes(raw, genomes, both_ways, score_scale)


def pair_archives(spark: SparkSession, paths: list[str], genomes: DataFrame, *, pattern: str = r"([A-Z0-9]{5})-([A-Z0-9]{5})\.[^/]*$", both_ways: bool = False, score_scale: float = 100.0) -> DataFrame:
    """As :func:`pair_files`, of the genome-pair files in tar archives (compressed by gzip or not): there are nearly as many pairs of genomes as
    relations, and a file system gives each small file a block of its own. Archives are read as streams, one member at a time."""

    def run(batches):
        name, most = re.compile(pattern), 50_000
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                if not stream.read(1):
                    continue
                stream.seek(0)
                rows = []
                with tarfile.open(fileobj=stream, mode="r|") as archive:
                    for member in archive:
                        if member.isfile() and (found := name.search(member.name)):
                            rows += [(*found.groups(), x) for x in archive.extractfile(member).read().decode().split("\n") if x.strip() and x[0] != "#"]
                        archive.members = []  # else every member met stays in memory
                        while len(rows) >= most:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[:most], strict=True)], names=["g1", "g2", "line"])
                            rows = rows[most:]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["g1", "g2", "line"])

    lines = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, "g1 string, g2 string, line string")
    return _between_genomes(lines.select("g1", "g2", F.from_csv("line", PAIR_SCHEMA, {"sep": "\t"}).alias("c")).select("g1", "g2", "c.*"), genomes, both_ways, score_scale)


def exported_json(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """Records of an exporter that wrote JSON lines, read in byte ranges, or one array, of which a file is read in one piece."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    reader = spark.read.option("multiLine", bool(first and first[0].lstrip().startswith("[")))
    return (reader.schema(schema) if schema else reader).json(path)


def domains(spark: SparkSession, path, *, sep: str | None = None) -> DataFrame:
    """(md5, domain_id, coords) from annotation files of three columns (md5, id, coordinates) or nine and more
    (md5 first, id in the second, coordinates in the fifth); '-' and ',' become ':'. Lines that are not of that form are dropped."""
    raw = spark.read.text(path)
    sep = sep or (r"\t" if raw.where(F.col("value").contains("\t")).limit(1).count() else ",")
    cells = F.split("value", sep, 9 if sep != "," else -1)
    wide = F.size(cells) >= 9
    coords = F.when(wide, F.try_element_at(cells, F.lit(5))).otherwise(F.array_join(F.slice(cells, 3, 100), ","))
    out = raw.select(F.lower(F.trim(cells[0])).alias("md5"), F.trim(F.try_element_at(cells, F.lit(2))).alias("domain_id"), F.translate(F.regexp_replace(coords, r"[\s\"]", ""), "-,", "::").alias("coords"))
    return out.where(F.col("md5").rlike("^[0-9a-f]{32}$") & F.col("coords").rlike("^[0-9]+(:[0-9]+)*$") & (F.col("domain_id") != ""))


def is_known_domain(col: str = "domain_id") -> Column:
    """Pfam accessions and CATH codes only."""
    return F.col(col).rlike(r"^PF") | F.col(col).rlike(r"^[1-4]\.")


def domain_names(spark: SparkSession, path) -> DataFrame:
    """(domain_id, source, description) from CATH name files (code, representative, :name) or Pfam ones (tab-separated)."""
    v = F.col("value")
    cath = r"^([0-9]+(?:\.[0-9]+)*)\s+\S+\s+:(.*)$"
    raw = spark.read.text(path).where(~v.startswith("#"))
    is_cath = v.rlike(cath)
    pf = F.split(v, "\t")
    return raw.select(
        F.when(is_cath, F.regexp_extract(v, cath, 1)).otherwise(pf[0]).alias("domain_id"),
        F.when(is_cath, "CATH/Gene3D").otherwise("Pfam").alias("source"),
        F.trim(F.when(is_cath, F.regexp_extract(v, cath, 2)).otherwise(F.coalesce(F.try_element_at(pf, F.lit(5)), F.try_element_at(pf, F.lit(2))))).alias("description"),
    ).where(is_cath | F.col("domain_id").rlike(r"^PF[0-9]{5}$"))


def obo(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of an OBO file: (term_nr, name, aspect, definition, alt_ids) and (child, parent, relation).

    Obsolete terms are skipped; relations are is_a and typed relationships; comments after '!' are ignored.
    """
    stanza = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\[)")).alias("s")).where(F.col("s").startswith("[Term]"))
    s = F.col("s")
    tag = lambda t: F.regexp_extract(s, rf"(?m)^{t}:[ \t]*(.*?)[ \t]*$", 1)
    nr = lambda c: F.regexp_extract(c, r"GO:0*([0-9]+)", 1).try_cast("bigint")
    live = stanza.where(~s.rlike(r"(?m)^is_obsolete:\s*true"))
    alt = F.transform(F.regexp_extract_all(s, F.lit(r"(?m)^alt_id:\s*GO:0*([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    terms = live.select(nr(tag("id")).alias("term_nr"), tag("name").alias("name"), tag("namespace").alias("aspect"), F.regexp_extract(s, r'(?m)^def:\s*"((?:[^"\\]|\\.)*)"', 1).alias("definition"), alt.alias("alt_ids"))
    isa = live.select(nr(tag("id")).alias("child"), F.explode(F.regexp_extract_all(s, F.lit(r"(?m)^is_a:\s*GO:0*([0-9]+)"), F.lit(1))).alias("p")).select("child", F.col("p").cast("bigint").alias("parent"), F.lit("is_a").alias("relation"))
    rel = live.select(nr(tag("id")).alias("child"), F.explode(F.regexp_extract_all(s, F.lit(r"(?m)^relationship:\s*(\w+\s+GO:[0-9]+)"), F.lit(1))).alias("r"))
    typed = rel.select("child", nr("r").alias("parent"), F.regexp_extract("r", r"^(\w+)", 1).alias("relation"))
    return terms.where("term_nr IS NOT NULL"), isa.unionByName(typed).where("child IS NOT NULL AND parent IS NOT NULL")


def gaf(spark: SparkSession, path) -> DataFrame:
    """Annotations of a GAF file with its 17 columns (missing trailing ones null) and the term number."""
    from phylolake.operators.annotations import GAF_COLUMNS
    from phylolake.operators.ontology import term_number

    schema = ", ".join(f"`{c}` string" for c in GAF_COLUMNS)
    return spark.read.csv(path, sep="\t", schema=schema, comment="!", quote="").withColumn("term_nr", term_number("GO_ID"))


def fasta(spark: SparkSession, path) -> DataFrame:
    """(id, description, sequence) of FASTA files; records may span any number of lines."""
    raw = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def loci(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, strand) of every exon of locus texts."""
    return df.select(F.col(key), F.explode(strings.exons(text)).alias("e")).select(key, "e.start", "e.end", "e.strand")


def xref_tsv(spark: SparkSession, path, schema: str = "entry_nr bigint, source int, xref_id string, verification int") -> DataFrame:
    """Additional cross-references, keyed by entry number; lines without a number or id are dropped."""
    return spark.read.csv(path, sep="\t", schema=schema, comment="#").where("entry_nr IS NOT NULL AND xref_id IS NOT NULL")


def taxonomy_tsv(spark: SparkSession, path) -> DataFrame:
    """(taxid, parent_taxid, name, age); a node that is its own parent is dropped."""
    return spark.read.csv(path, sep="\t", schema="taxid int, parent_taxid int, name string, age double", comment="#").where("taxid <> parent_taxid")


def with_defaults(df: DataFrame, defaults: dict, codes: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Missing or null columns filled with defaults, labels turned into enum codes (unknown labels become the default)."""
    out = df
    for name, mapping in (codes or {}).items():
        labels = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        out = out.withColumn(name, F.try_element_at(labels, F.col(name)))
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out


# -- tagged entry lines -----------------------------------------------------------------

# Tags of entry records, the source each feeds, its verification and how its text is split.
TAGS = (
    ("GI", "GI", "exact", "many"), ("EntrezGene", "EntrezGene", "exact", "many"), ("WikiGene", "WikiGene", "unchecked", "many"), ("IPI", "IPI", "unchecked", "many"),
    ("Refseq_ID", "RefSeq", "exact", "many"), ("SwissProt", "UniProtKB/SwissProt", "exact", "many"), ("GeneName", "Gene Name", "unchecked", "many"),
    ("ORFNames", "ORF Name", "unchecked", "many"), ("OrderedLocusNames", "Ordered Locus Name", "unchecked", "many"), ("ProtName", "Protein Name", "unchecked", "many"),
    ("Synonyms", "Synonym", "unchecked", "many"), ("HGNC_Id", "HGNC", "unchecked", "many"), ("PDB", "PDB", "unchecked", "many"),
    ("EMBL", "EMBL", "unchecked", "many"), ("SMR", "Swiss Model", "unchecked", "many"), ("ID", "SourceID", "exact", "many"), ("AC", "SourceAC", "exact", "many"),
    ("UniProt/TrEMBL", "UniProtKB/TrEMBL", "exact", "accession"), ("SwissProt_AC", "UniProtKB/TrEMBL", "exact", "accession"),
)
# Identifier forms that name another source.
ID_FORMS = (
    ("Ensembl Gene", r"^ENS[A-Z]{0,3}G[0-9]{11}$"), ("Ensembl Protein", r"^ENS[A-Z]{0,3}P[0-9]{11}$"), ("Ensembl Transcript", r"^ENS[A-Z]{0,3}T[0-9]{11}$"),
    ("FlyBase", r"^FB[gnptr]{2}[0-9]{7}$"), ("NCBI", r"^[A-Z]{3}[0-9]{5}\.[0-9]$"), ("WormBase", r"^WBGene[0-9]{8}$"),
)


def source_of_id(col: Column, default: Column) -> Column:
    """Source that the form of an identifier gives away."""
    c = default
    for source, form in reversed(ID_FORMS):
        c = F.when(col.rlike(form), F.lit(source)).otherwise(c)
    return c


def entry_lines(spark: SparkSession, path) -> DataFrame:
    """(record, tag, value) of files with one ``<E>...</E>`` record per line, numbered in file order from 1."""
    from pyspark.sql import Window

    lines = spark.read.text(path).where(F.col("value").contains("<E>")).withColumn("__at", F.monotonically_increasing_id())
    lines = lines.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = lines.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__off"))  # one row per input split
    per = lines.join(F.broadcast(offsets), "__part").withColumn("record", F.col("__off") + F.col("__row") + 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(<([^/<>][^<>]*)>[^<>]*</\2>)"), F.lit(1))
    each = per.select("record", F.explode(pairs).alias("p"))
    return each.select("record", F.regexp_extract("p", r"^<([^<>]*)>", 1).alias("tag"), F.regexp_extract("p", r"^<[^<>]*>([^<>]*)<", 1).alias("value"))


def entry_xrefs(tags: DataFrame) -> DataFrame:
    """(record, source, xref_id, verification) of tagged records, without repeats.

    Lists are split, repeat markers cut; source ids whose form belongs to a known
    database are listed under it as well; accessions lose their species suffix.
    """
    from phylolake.operators.idmap import VERIFICATION

    spark = tags.sparkSession
    dim = F.broadcast(spark.createDataFrame([(t, s, VERIFICATION[v], k) for t, s, v, k in TAGS], "tag string, source string, verification int, kind string"))
    j = tags.join(dim, "tag")
    text = F.when(F.col("kind") == "accession", strings.before_species_suffix("value")).otherwise(F.col("value"))
    ids = j.withColumn("xref_id", F.explode(strings.id_list(text))).select("record", "source", "xref_id", "verification")
    known = ids.where(F.col("source").isin("SourceID", "SourceAC")).withColumn("source", source_of_id(F.col("xref_id"), F.lit(None).cast("string"))).where("source IS NOT NULL")
    return ids.unionByName(known).groupBy("record", "source", "xref_id").agg(F.min("verification").alias("verification"))


def entry_ec(tags: DataFrame) -> DataFrame:
    """(record, ec) of well-formed enzyme codes."""
    return tags.where("tag = 'EC'").select("record", F.explode(strings.id_list("value")).alias("ec")).where(F.col("ec").rlike(r"^[0-9]+(\.([0-9]+|-)){3}$")).distinct()


def entry_descriptions(tags: DataFrame) -> DataFrame:
    return tags.where("tag = 'DE' AND value <> ''").select("record", F.col("value").alias("description"))


def entry_go(tags: DataFrame) -> DataFrame:
    """(record, term_nr, evidence, reference) of texts like ``GO:1@[[IDA,{'PMID:2'}],[IEA,{'R:1','R:2'}]]; ...``, one row per reference."""
    per_term = tags.where("tag = 'GO' AND value <> ''").select("record", F.explode(F.split("value", r";\s*(?=GO:)")).alias("t"))
    blocks = per_term.select("record", F.regexp_extract("t", r"GO:0*([0-9]+)", 1).try_cast("bigint").alias("term_nr"), F.explode(F.regexp_extract_all("t", F.lit(r"(\[[A-Z]+,\{[^}]*\}\])"), F.lit(1))).alias("b"))
    refs = blocks.select("record", "term_nr", F.regexp_extract("b", r"\[([A-Z]+),", 1).alias("evidence"), F.explode(F.regexp_extract_all("b", F.lit("'([^']*)'"), F.lit(1))).alias("reference"))
    return refs.where("term_nr IS NOT NULL").distinct()


def inserted_domains(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_nr, domain_id, coords) of domain rows keyed by sequence md5, each distinct row once per entry."""
    return rows.distinct().join(entries.select("entry_nr", "md5"), "md5").select("entry_nr", "domain_id", "coords")


def main_isoforms(entries: DataFrame, used: DataFrame) -> DataFrame:
    """(entry_nr, alt_splice) from splice lines.

    ``entries`` is (entry_nr, gene) for all variants of multi-variant genes, ``used`` lists the
    entry used for each gene; a gene without exactly one used variant is left unmarked (0).
    """
    u = entries.join(used.select("entry_nr").distinct(), "entry_nr", "left_semi").groupBy("gene").agg(F.min("entry_nr").alias("main"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return entries.join(u, "gene", "left").select("entry_nr", F.coalesce("main", F.lit(0)).alias("alt_splice"))


def header_columns(line: str, required: tuple[str, ...]) -> list[str]:
    """Column names of a header line; missing required ones raise."""
    names = re.split(r"\t|,", line.strip().lstrip("#"))
    missing = [r for r in required if r not in names]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return names


def homoeolog_tsv(spark: SparkSession, path) -> DataFrame:
    """Homoeolog pairs with their three inputs from a file with a header."""
    df = spark.read.csv(path, sep="\t", header=True)
    header_columns("\t".join(df.columns), ("EntryNr1", "EntryNr2", "SyntenyConservationLocal", "Distance", "TotalCopyNr"))
    return df.select(F.col("EntryNr1").cast("bigint").alias("entry_nr1"), F.col("EntryNr2").cast("bigint").alias("entry_nr2"), F.col("SyntenyConservationLocal").cast("double").alias("synteny"),
                     F.col("Distance").cast("double").alias("distance"), F.col("TotalCopyNr").cast("bigint").alias("copy_nr"))
