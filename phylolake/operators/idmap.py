"""Cross-references: mapping, reduction, search modes, resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylolake.errors import AmbiguousId, TooUnspecificQuery
from phylolake.functions import strings

# Enum codes of cross-reference sources (a lower code is the better source) and of verification.
SOURCES = {
    "UniProtKB/SwissProt": 0, "UniProtKB/TrEMBL": 10, "Ensembl Protein": 20, "Ensembl Gene": 25, "Ensembl Transcript": 30, "RefSeq": 40, "EntrezGene": 50,
    "FlyBase": 60, "WormBase": 65, "EnsemblGenomes": 70, "NCBI": 75, "EMBL": 80, "SourceID": 95, "SourceAC": 100, "HGNC": 105, "Gene Name": 110,
    "Synonym": 115, "Protein Name": 120, "ORF Name": 125, "Ordered Locus Name": 130, "PDB": 148, "Swiss Model": 150, "STRING": 151, "neXtProt": 152,
    "Bgee": 153, "EPD": 154, "ChEMBL": 156, "GlyConnect": 157, "SwissPalm": 158, "DisGeNET": 159, "WikiGene": 160, "IPI": 240, "GI": 241, "n/a": 255,
}
VERIFICATION = {"exact": 0, "unchecked": 2, "modified": 4}
UNSPECIFIC = 50_000
# Sources of canonical ids, best first, and sources that make a protein well referenced.
CANONICAL_ORDER = ("UniProtKB/SwissProt", "UniProtKB/TrEMBL", "Ensembl Gene", "Ensembl Protein", "FlyBase", "WormBase", "EnsemblGenomes", "RefSeq", "SourceID")
TRUSTED_SOURCES = ("UniProtKB/SwissProt", "UniProtKB/TrEMBL", "RefSeq", "EntrezGene", "Ensembl Gene", "Ensembl Protein")


@dataclass(frozen=True)
class Mapper:
    """A named choice of sources and of the worst verification accepted."""

    name: str
    sources: tuple[str, ...] | None = None
    verification: str = "unchecked"
    url: tuple[tuple[str, str], ...] = ()

    def best(self, xrefs: DataFrame) -> DataFrame:
        """The best id of every entry: the order of the mapper's own sources decides."""
        return best_per_entry(self.rows(xrefs), self.sources)

    def rows(self, xrefs: DataFrame) -> DataFrame:
        out = xrefs.where(F.col("verification") <= VERIFICATION[self.verification])
        if self.sources is not None:
            out = out.where(F.col("source").isin([SOURCES[s] for s in self.sources]))
        if self.url:
            c = F.lit(None).cast("string")
            for source, prefix in self.url:
                c = F.when(F.col("source") == SOURCES[source], F.concat(F.lit(prefix), F.col("xref_id"))).otherwise(c)
            out = out.withColumn("url", c)
        return out


# Sources of the named mappers, in their order of preference, and link prefixes.
MAPPERS = {
    m.name: m
    for m in (
        Mapper("all", None, "modified"),
        Mapper("uniprot", ("UniProtKB/SwissProt", "UniProtKB/TrEMBL"), "modified"),
        Mapper("no_approximate", None, "unchecked"),
        Mapper("gene_name_or_symbol", ("Gene Name", "UniProtKB/SwissProt", "UniProtKB/TrEMBL", "HGNC", "SourceID")),
        Mapper("gene_name_and_main", ("Gene Name", "UniProtKB/SwissProt", "UniProtKB/TrEMBL", "Ensembl Gene", "RefSeq", "EntrezGene", "SourceID")),
        Mapper("linkout", ("UniProtKB/SwissProt", "UniProtKB/TrEMBL", "Ensembl Protein", "Ensembl Gene", "EntrezGene"), "modified",
               (("UniProtKB/SwissProt", "http://uniprot.org/uniprot/"), ("UniProtKB/TrEMBL", "http://uniprot.org/uniprot/"), ("Ensembl Protein", "http://ensembl.org/id/"),
                ("Ensembl Gene", "http://ensembl.org/id/"), ("EntrezGene", "http://www.ncbi.nlm.nih.gov/gene/"))),
    )
}


def mapper(name: str) -> Mapper:
    """The mapper of that name (the registry is open: add to MAPPERS)."""
    return MAPPERS[name]


def xrefs_of(xrefs: DataFrame, entries: DataFrame | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Cross-references of a set of entries (semi-join) or of the half-open range [start, stop)."""
    nr = F.col("entry_nr")
    out = xrefs
    if start is not None:
        out = out.where((nr >= start) & (nr < (start + 1 if stop is None else stop)))
    return out if entries is None else out.join(entries.select("entry_nr").distinct(), "entry_nr", "left_semi")


def nested(xrefs: DataFrame) -> DataFrame:
    """(entry_nr, ids): map from source code to the first id."""
    first = xrefs.groupBy("entry_nr", "source").agg(F.min("xref_id").alias("id"))
    return first.groupBy("entry_nr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "id")))).alias("ids"))


def best_per_entry(xrefs: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """The id of the best source of every entry; ties go to the smaller id.

    Sources rank as listed in ``order`` (others are left out), without it by their code.
    """
    if order is None:
        rank, rows = F.col("source"), xrefs
    else:
        codes = [SOURCES[s] for s in order]
        rank, rows = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("source")), xrefs.where(F.col("source").isin(codes))
    return rows.groupBy("entry_nr").agg(F.min(F.struct(rank.alias("r"), "source", "xref_id")).alias("b")).select("entry_nr", "b.source", "b.xref_id")


def xref_summary(xrefs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: proteins with a cross-reference of a trusted source, in all, in a flat group, in a hierarchical group."""
    ok = xrefs.where(F.col("source").isin([SOURCES[s] for s in TRUSTED_SOURCES])).select("entry_nr").distinct()
    j = entries.select("entry_nr", "group_nr", "hog_id").join(ok, "entry_nr", "left_semi")
    return j.agg(F.count(F.lit(1)).alias("proteins"), F.count(F.when(F.col("group_nr") != 0, 1)).alias("in_group"), F.count(F.when(F.col("hog_id") != "", 1)).alias("in_hog"))


def canonical(xrefs: DataFrame, entries: DataFrame, ranked: list[int]) -> DataFrame:
    """(entry_nr, canonical_id): id of the best ranked source, at most unchecked; '' without any."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ranked]), F.col("source"))
    good = xrefs.where((F.col("verification") <= VERIFICATION["unchecked"]) & F.col("source").isin(ranked))
    best = good.groupBy("entry_nr").agg(F.min(F.struct(rank.alias("r"), "xref_id")).alias("b"))
    return entries.select("entry_nr").join(best, "entry_nr", "left").select("entry_nr", F.coalesce("b.xref_id", F.lit("")).alias("canonical_id"))


def reduce_xrefs(xrefs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per gene and lower-case versionless id: exact before unchecked, main isoform first, best source, smallest entry.

    (gene, xref, entry_nr, source, verification).
    """
    gene = F.when(F.col("alt_splice") == 0, F.col("entry_nr")).otherwise(F.col("alt_splice"))
    e = entries.select("entry_nr", gene.cast("bigint").alias("gene"))
    j = xrefs.join(e, "entry_nr").withColumn("xref", F.lower(strings.without_version("xref_id")))
    order = F.struct("verification", F.when(F.col("entry_nr") == F.col("gene"), 0).otherwise(1).alias("alt"), "source", "entry_nr")
    return j.groupBy("gene", "xref").agg(F.min(order).alias("b")).select("gene", "xref", "b.entry_nr", "b.source", "b.verification")


def frequent_names(reduced: DataFrame, sources: list[int], min_hits: int = 3) -> DataFrame:
    """(xref, n) of names that at least ``min_hits`` genes carry."""
    return reduced.where(F.col("source").isin(sources)).groupBy("xref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_hits)


def search(xrefs: DataFrame, query: str, mode: str = "suffix_if_no_prefix", *, entry_range: tuple[int, int] | None = None, limit: int | None = None, unspecific: int | None = None) -> DataFrame:
    """Rows whose id matches, ignoring case and version: exact, prefix, substring ('suffix'), or
    substring only where no id starts with the query.

    ``unspecific`` raises :class:`TooUnspecificQuery` for a substring query with more
    hits. Empty queries match nothing. The entry range is closed.
    """
    q = query.strip().lower()
    x = F.lower(strings.without_version("xref_id"))
    rows = xrefs if entry_range is None else xrefs.where(F.col("entry_nr").between(*entry_range))
    if not q:
        return rows.where(F.lit(False))
    exact, prefix, part = rows.where((x == q) | (F.lower("xref_id") == q)), rows.where(x.startswith(q)), rows.where(x.contains(q))
    if mode == "suffix_if_no_prefix":
        mode = "suffix" if prefix.isEmpty() else "prefix"
    out = {"exact": exact, "prefix": prefix, "suffix": part}[mode]
    if mode == "suffix" and unspecific is not None:
        hits = out.limit(unspecific + 1).count()
        if hits > unspecific:
            raise TooUnspecificQuery(f"{query!r} matches more than {unspecific} cross-references", hits)
    return out if limit is None else out.orderBy("entry_nr", "source", "xref_id").limit(limit)


def count(xrefs: DataFrame, query: str, mode: str = "suffix_if_no_prefix", *, entry_range: tuple[int, int] | None = None) -> int:
    """Number of cross-references a search of that mode finds; counted, not fetched."""
    return search(xrefs, query, mode, entry_range=entry_range).count()


def joined_ids(xrefs: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """(entry_nr, one column per kind): the smallest id of every kind, for all entries with any of them (full outer join of the kinds)."""
    out = None
    for name, source in kinds.items():
        own = xrefs.where(F.col("source") == source).groupBy("entry_nr").agg(F.min("xref_id").alias(name))
        out = own if out is None else out.join(own, "entry_nr", "full")
    return out


def search_id(xrefs: DataFrame, query: str) -> DataFrame:
    """Entries of an id, optionally written ``source:id``."""
    source, sep, term = query.partition(":")
    known = {k.lower(): v for k, v in SOURCES.items()}
    if sep and source.lower() in known:
        xrefs, query = xrefs.where(F.col("source") == known[source.lower()]), term
    return search(xrefs, query, "exact").select("entry_nr").distinct()


def resolve(query: str, entries: DataFrame, xrefs: DataFrame) -> int:
    """Entry number of an id: a number, a protein id, an exact, then a partial cross-reference.

    Several hits are fine only if they are isoforms of one gene (the main one is
    given); otherwise :class:`AmbiguousId` is raised, and for no hit :class:`InvalidId`.
    """
    from phylolake.errors import InvalidId

    q = query.strip()
    stages = []
    if q.isdigit():
        stages.append(lambda: entries.where(F.col("entry_nr") == int(q)))
    if len(q) >= 10 and q[5:].isdigit():
        first = entries.where(F.col("species_code") == q[:5].upper()).agg(F.min("entry_nr")).first()[0]
        if first is not None:
            stages.append(lambda: entries.where((F.col("species_code") == q[:5].upper()) & (F.col("entry_nr") == int(q[5:]))))
    for mode in ("exact", "suffix"):
        stages.append(lambda mode=mode: entries.join(search(xrefs, q, mode, unspecific=UNSPECIFIC).select("entry_nr").distinct(), "entry_nr", "left_semi"))
    gene = F.when(F.col("alt_splice") == 0, F.col("entry_nr")).otherwise(F.col("alt_splice"))
    for stage in stages:
        found = stage().select("entry_nr", gene.alias("gene"))
        n, low, genes = found.agg(F.count(F.lit(1)), F.min("gene"), F.countDistinct("gene")).first()
        if n:
            if genes > 1:  # decided over all hits; the search before refuses more than UNSPECIFIC of them
                raise AmbiguousId(f"{query!r} names {genes} genes", [r[0] for r in found.select("entry_nr").distinct().orderBy("entry_nr").collect()])
            return int(low)
    raise InvalidId(f"{query!r} names no entry")


def match_score(a: Column, b: Column) -> Column:
    """Similarity of two texts in [0, 1]: one minus edit distance over the longer length."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def fuzzy_match(queries: DataFrame, targets: DataFrame, query: str, target: str, *, key: str, cutoff: float = 0.6, n: int = 3) -> DataFrame:
    """(query, key, score) of targets similar to a query, the best text of every key.

    A score of ``cutoff`` allows (1 - cutoff) edits per letter of the longer text. Candidates fit in length and share at least as many
    letter n-grams (the repeats of one numbered) as so many edits leave; where none need be left, texts are compared by length alone.
    All are ranked by edit distance.
    """

    def grams(c):
        padded = F.concat(F.lit("$"), F.lower(c), F.lit("$"))
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.transform(every, lambda x, i: F.struct(x.alias("text"), F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda y: y == x)).alias("nr")))

    def lengths(c):
        return F.length(F.lower(c))

    def left(longest):  # n-grams of a padded text of that length that the edits cannot reach
        return longest + 2 - (n - 1) - n * F.floor((1 - cutoff) * longest + 1e-9)

    q = queries.select(F.col(query).alias("query")).where("query IS NOT NULL AND query <> ''").distinct().withColumn("lq", lengths("query"))
    t = targets.select(key, F.col(target).alias("text")).where("text IS NOT NULL AND text <> ''").distinct().withColumn("lt", lengths("text"))
    longest = F.greatest("lq", "lt")
    fits = F.abs(F.col("lq") - F.col("lt")) <= (1 - cutoff) * longest + 1e-9
    qa, ta = q.withColumn("g", F.explode(grams(F.col("query")))), t.withColumn("g", F.explode(grams(F.col("text"))))
    shared = qa.join(ta, "g").where(fits).groupBy("query", key, "text", "lq", "lt").agg(F.count(F.lit(1)).alias("n")).where((left(longest) > 0) & (F.col("n") >= left(longest)))
    near = F.sequence(F.floor(F.col("lq") * cutoff - 1e-9), F.ceil(F.col("lq") / max(cutoff, 1e-9) + 1e-9)) if cutoff > 0 else None
    free = q.withColumn("lt", F.explode(near)).join(t, "lt") if near is not None else q.crossJoin(t)
    cand = shared.select("query", key, "text").unionByName(free.where(fits & (left(longest) <= 0)).select("query", key, "text"))
    scored = cand.withColumn("score", match_score(F.col("query"), F.col("text"))).where(F.col("score") >= cutoff)
    return scored.groupBy("query", key).agg(F.max("score").alias("score"))


def resolve_genome(genomes: DataFrame, query) -> DataFrame:
    """Genomes named by a taxon id (integer), a five-letter code, or a scientific name."""
    if isinstance(query, int) or str(query).isdigit():
        return genomes.where(F.col("taxid") == int(query))
    if len(query) == 5:
        hit = genomes.where(F.col("species_code") == query.upper())
        if not hit.isEmpty():
            return hit
    return genomes.where(F.col("sci_name") == query)


def pivot_sources(xrefs: DataFrame, sources: list[int], sep: str = " _|_ ") -> DataFrame:
    """One column per source with the joined ids of every entry."""
    text = F.array_join(F.array_sort(F.collect_set("xref_id")), sep)
    wide = xrefs.where(F.col("source").isin(sources)).groupBy("entry_nr").pivot("source", sources).agg(text)
    return wide.select("entry_nr", *[F.coalesce(F.col(f"`{s}`"), F.lit("")).alias(f"s{s}") for s in sources])
