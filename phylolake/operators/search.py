"""Combined search: typed tokens answer in entries, groups, genomes and clades, and narrow each other."""

from __future__ import annotations

from abc import ABC
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.functions import hogid, sequence
from phylolake.operators import annotations, idmap, ontology
from phylolake.operators.sequences import exact_search, kmer_search

AUTO_LIMIT = 1000


@dataclass
class Corpus:
    """The tables a search runs on; those not needed by the tokens may be None."""

    entries: DataFrame
    xrefs: DataFrame | None = None
    hogs: DataFrame | None = None
    go: DataFrame | None = None
    ec: DataFrame | None = None
    domains: DataFrame | None = None
    genomes: DataFrame | None = None
    taxonomy: DataFrame | None = None
    tree: DataFrame | None = None
    sequences: DataFrame | None = None
    hog_map: DataFrame | None = None
    term_tree: DataFrame | None = None


ASPECTS = {"entries": ["entry_nr"], "groups": ["group_nr"], "hogs": ["hog_id"], "species": ["taxid"], "clades": ["taxid"]}


@dataclass
class Result:
    """One DataFrame of keys per aspect; None leaves the aspect unconstrained."""

    entries: DataFrame | None = None
    groups: DataFrame | None = None
    hogs: DataFrame | None = None
    species: DataFrame | None = None
    clades: DataFrame | None = None

    def __and__(self, other: Result) -> Result:
        both = {}
        for aspect, keys in ASPECTS.items():
            a, b = getattr(self, aspect), getattr(other, aspect)
            both[aspect] = b if a is None else a if b is None else a.join(b.select(*keys).distinct(), keys, "left_semi")
        return Result(**both)


@dataclass
class Token(ABC):
    """A search term. Lower PRIORITY is evaluated first; later tokens see the entries found so far."""

    term: str
    limit: int | None = field(default=None, kw_only=True)
    PRIORITY = 100

    def search(self, corpus: Corpus, allowed: DataFrame | None = None) -> Result:
        raise NotImplementedError

    def _cut(self, df: DataFrame) -> DataFrame:
        return df if self.limit is None else df.orderBy(df.columns[0]).limit(self.limit)


def _narrow(df: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return df if allowed is None else df.join(allowed.select("entry_nr").distinct(), "entry_nr", "left_semi")


class TaxToken(Token):
    """A clade or genome by id, code, exact name, then similar name."""

    PRIORITY = 10

    def search(self, corpus, allowed=None):
        t = corpus.taxonomy
        hit = t.where(F.col("taxid") == int(self.term)) if self.term.lstrip("-").isdigit() else t.where(F.lower("name") == self.term.lower())
        if hit.isEmpty() and corpus.genomes is not None:
            hit = idmap.resolve_genome(corpus.genomes, self.term).select("taxid")
        if hit.isEmpty():
            q = t.sparkSession.createDataFrame([(self.term,)], "q string")
            hit = idmap.fuzzy_match(q, t, "q", "name", key="taxid", cutoff=0.8).orderBy(F.desc("score"), "taxid").limit(1)
        below = corpus.tree.join(hit.select(F.col("taxid").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("taxid")).distinct()
        species = below.join(corpus.genomes.select("taxid"), "taxid", "left_semi")
        return Result(entries=_narrow(corpus.entries.join(species, "taxid", "left_semi").select("entry_nr"), allowed), species=species, clades=hit.select("taxid"))


class ECToken(Token):
    PRIORITY = 25

    def search(self, corpus, allowed=None):
        return Result(entries=self._cut(annotations.entries_with(corpus.ec, "ec", self.term, allowed=allowed)))


class GOToken(Token):
    """Entries annotated with a term or one of its descendants."""

    PRIORITY = 30

    def search(self, corpus, allowed=None):
        spark = corpus.go.sparkSession
        nr = spark.createDataFrame([(self.term,)], "t string").select(ontology.term_number("t").alias("term_nr"))
        terms = nr if corpus.term_tree is None else corpus.term_tree.join(nr.withColumnRenamed("term_nr", "ancestor"), "ancestor", "left_semi").select(F.col("descendant").alias("term_nr")).distinct()
        return Result(entries=self._cut(_narrow(corpus.go.join(terms, "term_nr", "left_semi").select("entry_nr").distinct(), allowed)))


class DomainToken(Token):
    PRIORITY = 40

    def search(self, corpus, allowed=None):
        return Result(entries=self._cut(annotations.entries_with(corpus.domains, "domain_id", self.term, allowed=allowed)))


class GroupToken(Token):
    """A flat group by number."""

    PRIORITY = 50

    def search(self, corpus, allowed=None):
        nr = int("".join(c for c in self.term if c.isdigit()) or 0)
        e = corpus.entries.where((F.col("group_nr") == nr) & (F.col("group_nr") != 0))
        return Result(entries=self._cut(_narrow(e.select("entry_nr"), allowed)), groups=e.select("group_nr").distinct())


class HogToken(Token):
    """A hierarchical group by id (the prefix may be missing); ids of another release go through the forward map;
    an unknown id falls back to its family."""

    PRIORITY = 70

    def search(self, corpus, allowed=None):
        q = self.term.strip().split("_")[0]
        q = q if q.upper().startswith("HOG:") else "HOG:" + q
        exact = corpus.hogs.where(F.col("hog_id") == q).select("hog_id").distinct()
        if exact.isEmpty() and corpus.hog_map is not None:
            exact = corpus.hog_map.where(F.col("old_id") == q).orderBy(F.desc("jaccard"), "new_id").limit(1).select(F.col("new_id").alias("hog_id"))
        if exact.isEmpty():
            exact = corpus.hogs.where(F.col("hog_id") == q.split(".")[0]).select("hog_id").distinct()
        found = exact.first()
        if found is None:
            empty = corpus.entries.where(F.lit(False))
            return Result(entries=empty.select("entry_nr"), hogs=exact)
        return Result(entries=self._cut(_narrow(corpus.entries.where(hogid.within("hog_id", found[0])).select("entry_nr"), allowed)), hogs=exact)


class XRefToken(Token):
    """Entries by cross-reference; a too unspecific substring matches nothing."""

    PRIORITY = 85

    def search(self, corpus, allowed=None):
        x = corpus.xrefs if allowed is None else annotations.filter_entries(corpus.xrefs, allowed)
        try:
            hits = idmap.search(x, self.term, unspecific=idmap.UNSPECIFIC)
        except idmap.TooUnspecificQuery:
            hits = x.where(F.lit(False))
        return Result(entries=self._cut(hits.select("entry_nr").distinct()))


class SequenceToken(Token):
    """Entries by sequence: exact containment, else shared words; at least five residues."""

    PRIORITY = 90

    def search(self, corpus, allowed=None):
        spark = corpus.sequences.sparkSession
        seqs = _narrow(corpus.sequences, allowed)
        clean = spark.createDataFrame([(self.term,)], "q string").select(sequence.sanitise("q")).first()[0]
        if len(clean) < 5:
            return Result(entries=seqs.where(F.lit(False)).select("entry_nr"))
        exact = exact_search(seqs, clean, id_col="entry_nr")
        hits = exact if not exact.isEmpty() else kmer_search(seqs, clean, id_col="entry_nr", coverage=0.5)
        return Result(entries=self._cut(hits.select("entry_nr").distinct()))


def combined_search(corpus: Corpus, tokens: list[Token], *, entry_limit: int | None = None) -> Result:
    """Intersection of all tokens' answers; ``entry_limit`` applies to the combined entries."""
    result = Result()
    for token in sorted(tokens, key=lambda t: t.PRIORITY):
        result = result & token.search(corpus, result.entries)
    if entry_limit is not None and result.entries is not None:
        result.entries = result.entries.orderBy("entry_nr").limit(entry_limit)
    return result


def search_protein(corpus: Corpus, query: str, *, descriptions: DataFrame | None = None, few: int = 5) -> DataFrame:
    """(entry_nr, source): free-text hits by number, protein id and cross-reference; descriptions only
    where fewer than ``few`` cross-references match."""
    e, q = corpus.entries, query.strip()
    parts = [e.where(F.col("entry_nr") == int(q)).select("entry_nr", F.lit("number").alias("source"))] if q.isdigit() else []
    x = idmap.search(corpus.xrefs, q, "suffix").select("entry_nr").distinct().withColumn("source", F.lit("xref"))
    parts.append(x)
    if descriptions is not None and x.limit(few).count() < few:
        parts.append(descriptions.where(F.lower("description").contains(q.lower())).select("entry_nr", F.lit("description").alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
