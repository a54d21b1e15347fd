"""Canonical tables of a release (DDL) and their layout on disk."""

from __future__ import annotations

SCHEMA_VERSION = (3, 7)

TABLES: dict[str, str] = {
    "metadata": "key string, value string",
    "genome": "species_code string, taxid int, entry_off bigint, tot_entries bigint, tot_aa bigint, tot_genes bigint, sci_name string, common_name string, syn_name string, release string, url string, source string, date timestamp, polyploid int",
    "taxonomy": "taxid int, parent_taxid int, name string, age double",
    "entry": "entry_nr bigint, species_code string, taxid int, group_nr bigint, hog_id string, fam bigint, chromosome string, locus_start bigint, locus_end bigint, strand tinyint, alt_splice int, canonical_id string, md5 string, subgenome string",
    "sequence": "entry_nr bigint, seq string, cdna string, description string",
    "exon": "entry_nr bigint, start bigint, end bigint, strand tinyint",
    "pairwise": "entry_nr1 bigint, entry_nr2 bigint, rel_type int, score double, distance double, overlap double, synteny double, confidence double",
    "hog_level": "fam bigint, hog_id string, level string, completeness double, implied_losses int, nr_members int, is_root boolean, idx_per_level bigint",
    "xref": "entry_nr bigint, source int, xref_id string, verification int",
    "go_annotation": "entry_nr bigint, term_nr bigint, evidence string, reference string",
    "go_term": "term_nr bigint, name string, aspect string, definition string",
    "go_edge": "child bigint, parent bigint, relation string",
    "go_term_counts": "term_nr bigint, n bigint",
    "ec": "entry_nr bigint, ec string",
    "domain": "entry_nr bigint, domain_id string, coords string, dom_start bigint, dom_end bigint",
    "domain_description": "domain_id string, source string, description string",
    "group_meta": "group_nr bigint, fingerprint string, keywords string, n_members bigint",
    "roothog_meta": "fam bigint, keywords string, family_json string",
    "orthoxml": "fam bigint, xml string, xml_augmented string",
    "ancestral_synteny": "taxid int, node1 string, node2 string, weight double, evidence int",
    "ancestral_go": "taxid int, hog_id string, term_nr bigint, score int, raw_score double",
    "ortholog_counts": "entry_nr bigint, n_pairwise bigint, n_induced_orthologs bigint, n_induced_paralogs bigint, n_group bigint, n_any bigint",
    "hog_map": "old_id string, new_id string, jaccard double, dubious boolean",
    "hog_profile": "fam bigint, species int",
    "best_match": "genome1 string, genome2 string, entry_nr1 bigint, entry_nr2 bigint, score double, distance double, variance double, sum_lengths int, is_stable boolean, is_verified boolean, is_canonical boolean",
}

#: (partition columns, sort columns) each table is written with.
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "entry": (["species_code"], ["entry_nr"]), "pairwise": ([], ["entry_nr1", "entry_nr2"]), "hog_level": ([], ["fam", "hog_id"]), "xref": ([], ["entry_nr"]),
    "go_annotation": ([], ["entry_nr", "term_nr"]), "domain": ([], ["entry_nr"]), "sequence": ([], ["entry_nr"]), "exon": ([], ["entry_nr"]),
    "ancestral_synteny": (["taxid"], ["node1"]), "ancestral_go": (["taxid"], ["hog_id"]), "best_match": (["genome1"], ["genome2", "entry_nr1"]), "orthoxml": ([], ["fam"]),
}
