"""The release as one object: every lookup returns a lazy DataFrame (or a small model)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake import models, schemas
from phylolake.errors import InvalidId, SchemaVersionError, Singleton, UnknownSpecies
from phylolake.functions import hogid, strings
from phylolake.operators import annotations, enrichment, groups, hierarchy, idmap, ontology, relations, scans, search, sequences, similarity, summary, synteny
from phylolake.sinks import writers


class Release:
    """Tables of one release under ``root`` (parquet folders named as in :mod:`schemas`), or given as DataFrames."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.root, self._tables = spark, root, dict(tables or {})
        self._check_version()

    def _check_version(self) -> None:
        try:
            row = self.table("metadata").where("key = 'schema_version'").first()
        except Exception:  # a release without metadata is accepted
            row = None
        if row and int(row["value"].split(".")[0]) != schemas.SCHEMA_VERSION[0]:
            raise SchemaVersionError(f"schema version {row['value']}, expected {schemas.SCHEMA_VERSION[0]}.x")

    def table(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise KeyError(name)
        if name not in self._tables:
            if self.root is None:
                self._tables[name] = self.spark.createDataFrame([], schemas.TABLES[name])
            else:
                self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def save(self, name: str, rows: DataFrame, *, mode: str = "overwrite") -> None:
        """Write a table in its layout: partitioned for pruning, sorted for row-group statistics."""
        parts, order = schemas.LAYOUT.get(name, ([], []))
        writers.save_table(rows, f"{self.root}/{name}.parquet", mode=mode, partition_by=parts, sort_by=order)
        self._tables.pop(name, None)

    # -- trees ------------------------------------------------------------------------
    @cached_property
    def taxonomy(self) -> DataFrame:
        return hierarchy.with_single_root(self.table("taxonomy"))

    @cached_property
    def tree(self) -> DataFrame:
        """Closure of the taxonomy; computed once and kept."""
        t = self.taxonomy
        known = t.select(F.col("taxid").alias("parent_taxid"))
        return hierarchy.closure(t.join(known, "parent_taxid", "left_semi"), "taxid", "parent_taxid", t, "taxid").cache()

    @cached_property
    def term_tree(self) -> DataFrame:
        e = self.table("go_edge").where("relation IN ('is_a', 'part_of')")
        return hierarchy.closure(e, "child", "parent", self.table("go_term"), "term_nr").cache()

    def lineage(self, taxid: int) -> DataFrame:
        return hierarchy.lineage(self.tree, taxid).join(self.taxonomy.select("taxid", "name"), "taxid")

    def subtree(self, taxid: int) -> DataFrame:
        return hierarchy.subtree(self.tree, taxid)

    def extant_genomes(self, taxid: int | None = None) -> DataFrame:
        g = self.table("genome")
        return g if taxid is None else g.join(self.subtree(taxid).select("taxid"), "taxid", "left_semi")

    def induced_taxonomy(self, taxa: DataFrame, *, collapse: bool = False, with_ancestors: bool = False) -> DataFrame:
        return hierarchy.induced_tree(self.tree, taxa, collapse=collapse, keep=self.table("genome"), with_ancestors=with_ancestors)

    def newick(self) -> str:
        species = {r.taxid: r.species_code for r in self.table("genome").select("taxid", "species_code").collect()}
        return hierarchy.to_newick(self.taxonomy, species=species)

    def valid_levels(self) -> DataFrame:
        return self.taxonomy.where(hierarchy.valid_level_name("name")).select("name")

    # -- genomes and entries ------------------------------------------------------------
    def genome(self, query) -> models.Genome:
        row = idmap.resolve_genome(self.table("genome"), query).first()
        if row is None:
            raise UnknownSpecies(str(query))
        return models.Genome(self, row)

    def similar_genomes(self, name: str, *, limit: int = 10) -> DataFrame:
        q = self.spark.createDataFrame([(name,)], "q string")
        return idmap.fuzzy_match(q, self.table("genome"), "q", "sci_name", key="taxid").orderBy(F.desc("score"), "taxid").limit(limit)

    def entry(self, nr: int) -> models.Protein:
        return models.Protein(self, scans.the_one(self.table("entry"), "entry_nr", int(nr)))

    def resolve(self, query: str) -> models.Protein:
        return self.entry(idmap.resolve(query, self.table("entry"), self.table("xref")))

    def protein_id(self, nr: int) -> str:
        e = self.entry(nr)
        g = self.genome(e.row.species_code)
        return f"{g.row.species_code}{nr - g.row.entry_off:05d}"

    def entry_of_protein_id(self, pid: str) -> int:
        code, local = pid[:5].upper(), pid[5:]
        g = self.genome(code)
        if not local.isdigit() or not 1 <= int(local) <= g.row.tot_entries:
            raise InvalidId(pid)
        return g.row.entry_off + int(local)

    def proteins_of(self, genome) -> DataFrame:
        g = self.genome(genome).row
        return self.table("entry").where(F.col("species_code") == g.species_code)

    def main_isoforms(self, genome=None) -> DataFrame:
        e = self.table("entry") if genome is None else self.proteins_of(genome)
        return e.where(relations.is_main_isoform())

    def isoforms(self, nr: int) -> DataFrame:
        main = self.entry(nr).row.alt_splice or nr
        return self.table("entry").where((F.col("alt_splice") == main) | (F.col("entry_nr") == nr))

    def sequence(self, nr: int) -> DataFrame:
        return scans.point(self.table("sequence"), "entry_nr", nr)

    def exons(self, nr: int) -> DataFrame:
        return scans.point(self.table("exon"), "entry_nr", nr)

    def neighbours(self, nr: int, window: int = 1) -> DataFrame:
        e = self.table("entry").where(F.col("species_code") == self.entry(nr).row.species_code)
        return synteny.neighbours(e, scans.point(e, "entry_nr", nr), window)

    def chromosomes(self, genome) -> DataFrame:
        return summary.chromosome_genes(self.proteins_of(genome))

    # -- relations ----------------------------------------------------------------------
    def pairs(self, nr: int, types: list[int] | None = None) -> DataFrame:
        return relations.of_entry(self.table("pairwise"), nr, types)

    def orthologs(self, nr: int) -> DataFrame:
        return self.pairs(nr, [0, 1, 2, 3])

    def homoeologs(self, nr: int) -> DataFrame:
        return self.pairs(nr, [5])

    def close_paralogs(self, nr: int) -> DataFrame:
        return self.pairs(nr, [4, 5])

    def pairs_between(self, g1, g2) -> DataFrame:
        a, b = (self.genome(g).row for g in (g1, g2))
        return relations.between_genomes(self.table("pairwise"), (a.entry_off + 1, a.entry_off + a.tot_entries), (b.entry_off + 1, b.entry_off + b.tot_entries))

    def induced_orthologs(self, g1, g2) -> DataFrame:
        codes = [self.genome(g).row.species_code for g in (g1, g2)]
        return relations.induced_orthologs(self.main_isoforms().where(F.col("species_code").isin(codes)))

    def induced_partners(self, nr: int, *, orthologs: bool = True) -> DataFrame:
        """Induced orthologs (or paralogs) of one entry."""
        q = self.entry(nr).row
        if not q.hog_id:
            raise Singleton(f"entry {nr} is in no hierarchical group")
        fam = self.main_isoforms().where((F.col("fam") == q.fam) & (F.col("entry_nr") != nr))
        test = hogid.are_orthologous(F.lit(q.hog_id), F.col("hog_id"))
        return fam.where(test if orthologs else ~test).withColumn("common_id", hogid.common_group(F.lit(q.hog_id), F.col("hog_id")))

    def ortholog_counts(self) -> DataFrame:
        return relations.ortholog_counts(self.table("pairwise").where("rel_type <= 3"), self.main_isoforms())

    # -- groups -------------------------------------------------------------------------
    def hog(self, hog_id: str, level: str | None = None) -> models.Hog:
        row = groups.root_row(self.table("hog_level"), hog_id, level).first()
        if row is None:
            raise InvalidId(hog_id)
        return models.Hog(self, row)

    def hog_members(self, hog_id: str, level: str | None = None) -> DataFrame:
        if level is None:
            return groups.members(self.table("entry"), hog_id)
        clade = self.subtree(self.taxid_of(level)).select("taxid")
        return groups.members_at_level(self.table("entry"), self.table("hog_level"), hog_id, level, clade)

    def hogs_at_level(self, level: str, compare_with: str | None = None) -> DataFrame:
        h = self.table("hog_level")
        here = h.where(F.col("level") == level)
        return here if compare_with is None else groups.compare_levels(h.where(F.col("level") == compare_with), here)

    def subhogs(self, hog_id: str, level: str, *, include_subids: bool = True, include_leaves: bool = True) -> DataFrame:
        names = self.taxonomy.select("taxid", F.col("name").alias("level"))
        below = self.subtree(self.taxid_of(level)).where("dist > 0").join(names, "taxid")
        leaf = None if include_leaves else hierarchy.leaves(self.taxonomy).join(names, "taxid")
        return groups.subhogs(self.table("hog_level"), hog_id, below, include_subids=include_subids, leaf_levels=leaf)

    def parent_hogs(self, hog_id: str, taxid: int) -> DataFrame:
        """Ancestor groups on the lineage of a taxon, root-most first."""
        line = self.lineage(taxid).select(F.col("name").alias("level"), "dist")
        ids = self.spark.createDataFrame([(hog_id,)], "hog_id string")
        return groups.parent_hogs(ids, self.table("hog_level"), line).orderBy(F.desc("dist"), F.length("parent_id"))

    def flat_group(self, query) -> DataFrame:
        return summary.group_fingerprint_lookup(self.table("group_meta"), str(query))

    def flat_group_members(self, nr: int) -> DataFrame:
        return self.table("entry").where((F.col("group_nr") == nr) & (F.col("group_nr") != 0))

    def taxid_of(self, level: str) -> int:
        if level == "LUCA":
            return 0
        return scans.the_one(self.taxonomy, "name", level)["taxid"]

    def most_similar_genomes(self, genome, *, limit: int = 10, kind: str = "group", least: bool = False) -> DataFrame:
        e = self.table("entry")
        shared = groups.shared_groups(e, "group_nr", 0) if kind == "group" else groups.shared_groups(e, "fam")
        return groups.most_similar_genomes(shared, self.genome(genome).row.species_code, limit, least=least)

    def orthoxml(self, fam: int, *, augmented: bool = False) -> DataFrame:
        return scans.point(self.table("orthoxml"), "fam", fam).select("fam", F.col("xml_augmented" if augmented else "xml").alias("xml"))

    def family_keywords(self, fam: int) -> DataFrame:
        return scans.point(self.table("roothog_meta"), "fam", fam).select("fam", "keywords")

    def family_json(self, fam: int) -> DataFrame:
        return scans.point(self.table("roothog_meta"), "fam", fam).select("fam", "family_json")

    def map_hog(self, old_id: str) -> DataFrame:
        return self.table("hog_map").where(F.col("old_id") == old_id).select("new_id", "jaccard")

    def syntenic_hogs(self, taxid: int, hog_id: str | None = None, *, evidence: str = "parsimonious", steps: int = 2) -> DataFrame:
        edges = synteny.evidence_filter(scans.point(self.table("ancestral_synteny"), "taxid", taxid), evidence)
        if hog_id is None:
            return edges
        return synteny.neighbourhood(edges, self.spark.createDataFrame([(hog_id,)], "node string"), steps)[1]

    def neighbour_hogs(self, taxid: int, hog_id: str) -> DataFrame:
        return synteny.direct_neighbours(scans.point(self.table("ancestral_synteny"), "taxid", taxid), hog_id)

    def similar_profiles(self, fam: int, *, k: int = 50) -> DataFrame:
        p = self.table("hog_profile").select("fam", "species").distinct()
        return similarity.profile_neighbours(p, "fam", "species", self.spark.createDataFrame([(fam,)], "fam bigint"), k=k)

    # -- annotations --------------------------------------------------------------------
    def go(self, start: int, stop: int | None = None) -> DataFrame:
        return annotations.without_obsolete(annotations.of_range(self.table("go_annotation"), start, stop), self.table("go_term"))

    def gaf(self, start: int, stop: int | None = None, *, db: str = "LAKE", date: str = "") -> DataFrame:
        e = self.table("entry").join(self.table("genome").select("species_code", "entry_off"), "species_code")
        e = e.withColumn("protein_id", strings.protein_id("species_code", F.col("entry_nr") - F.col("entry_off")))
        return annotations.to_gaf(self.go(start, stop), e, self.table("go_term"), db=db, date=date)

    def ec(self, start: int, stop: int | None = None) -> DataFrame:
        return annotations.of_range(self.table("ec"), start, stop)

    def domains(self, start: int, stop: int | None = None) -> DataFrame:
        return annotations.of_range(self.table("domain"), start, stop)

    def ancestral_go(self, taxid: int, hog_id: str | None = None) -> DataFrame:
        a = scans.point(self.table("ancestral_go"), "taxid", taxid)
        return a if hog_id is None else a.where(F.col("hog_id") == hog_id)

    def entries_with_go(self, term, **options) -> DataFrame:
        nr = self.spark.createDataFrame([(str(term),)], "t string").select(ontology.term_number("t")).first()[0]
        if nr is None:
            raise InvalidId(f"{term!r} is no term")
        return annotations.entries_with(self.table("go_annotation"), "term_nr", nr, **options)

    def enrichment_of_genome(self, genome, study: DataFrame, *, alpha: float | None = 0.05) -> DataFrame:
        """Terms over-represented in entries of one genome against its main isoforms."""
        pop = self.main_isoforms(genome)
        if not study.select("entry_nr").join(pop, "entry_nr", "left_anti").isEmpty():
            raise ValueError("the study holds entries that are no main isoforms of the genome")
        return enrichment.enrichment(self.table("go_annotation"), study, self.term_tree, population=pop, alpha=alpha)

    def enrichment_of_level(self, taxid: int, study: DataFrame, *, score_cutoff: float = 0.1, alpha: float | None = 0.05) -> DataFrame:
        """Terms over-represented in ancestral groups (hog_id) against all groups of the level."""
        a = self.ancestral_go(taxid).where(F.col("raw_score") > score_cutoff)
        return enrichment.enrichment(a, study, self.term_tree, by="hog_id", alpha=alpha)

    # -- search -------------------------------------------------------------------------
    def corpus(self) -> search.Corpus:
        return search.Corpus(
            entries=self.table("entry"), xrefs=self.table("xref"), hogs=self.table("hog_level"), go=self.table("go_annotation"), ec=self.table("ec"), domains=self.table("domain"),
            genomes=self.table("genome"), taxonomy=self.taxonomy, tree=self.tree, sequences=self.table("sequence"), hog_map=self.table("hog_map"), term_tree=self.term_tree,
        )

    def search(self, tokens: list[search.Token], *, entry_limit: int | None = None) -> search.Result:
        return search.combined_search(self.corpus(), tokens, entry_limit=entry_limit)

    def search_protein(self, query: str) -> DataFrame:
        return search.search_protein(self.corpus(), query, descriptions=self.table("sequence").select("entry_nr", "description"))

    def xrefs(self, start: int, stop: int | None = None, *, mapper: str = "all") -> DataFrame:
        return idmap.mapper(mapper).rows(idmap.xrefs_of(self.table("xref"), start=start, stop=stop))

    def search_sequence(self, queries: DataFrame, **options) -> DataFrame:
        return sequences.sequence_search(queries, self.table("sequence"), id_col="entry_nr", **options)

    def project_functions(self, queries: DataFrame) -> DataFrame:
        return sequences.project_annotations(queries, self.table("sequence"), self.table("go_annotation"), id_col="entry_nr")

    def closest_sequences(self, queries: DataFrame) -> DataFrame:
        return sequences.closest_sequences(queries, self.table("sequence"), id_col="entry_nr")
