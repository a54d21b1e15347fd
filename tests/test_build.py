from phylolake.api import Release
from phylolake.operators import enrichment, hierarchy, ontology
from phylolake.plans import build
from phylolake.schemas import TABLES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_build_and_rebuild(spark, frame, tmp_path):
    def t(name, data):
        cols = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
        return spark.createDataFrame([tuple(d.get(c) for c in cols) for d in data], TABLES[name])

    protein = "species_code string, local_nr bigint, seq string, cdna string, description string, group_nr bigint, hog_id string, chromosome string, locus_start bigint, locus_end bigint, strand tinyint, alt_splice int, subgenome string"
    raw = {
        "genome": t("genome", [dict(species_code="BBBBB", taxid=12, tot_entries=2, polyploid=1), dict(species_code="AAAAA", taxid=11, tot_entries=3, polyploid=0)]),
        "taxonomy": t("taxonomy", [dict(taxid=1, parent_taxid=0, name="Root"), dict(taxid=11, parent_taxid=1, name="A"), dict(taxid=12, parent_taxid=1, name="B")]),
        "protein": frame(
            [("AAAAA", 1, "ACD", "ATGATGATG", None, 7, "HOG:E0000001", "1", 1, 9, 1, None, None), ("AAAAA", 2, None, None, "x", None, None, None, 20, 30, 1, 0, None), ("AAAAA", 3, "KK", None, None, 7, "HOG:E0000001", "1", 40, 50, 1, 0, None),
             ("BBBBB", 1, "MM", None, None, 7, "HOG:E0000001", "1", 1, 6, 1, 0, "A"), ("BBBBB", 2, "ML", None, None, None, "HOG:E0000001", "2", 5, 10, 1, 0, "B")], protein),
        "pairwise": t("pairwise", [dict(entry_nr1=1, entry_nr2=4, rel_type=6, distance=1.0), dict(entry_nr1=3, entry_nr2=4, rel_type=6, distance=2.0), dict(entry_nr1=4, entry_nr2=5, rel_type=5, distance=3.0)]),
        "hog_level": t("hog_level", [dict(fam=1, hog_id="HOG:E0000001", level="Root", is_root=True)]).drop("idx_per_level"),
        "group_meta": t("group_meta", [dict(group_nr=8, fingerprint="ABCDEFG")]),
        "xref": t("xref", [dict(entry_nr=1, source=10, xref_id="T1", verification=0), dict(entry_nr=1, source=0, xref_id="P1", verification=4), dict(entry_nr=4, source=95, xref_id="S4", verification=2)]),
        "go_term": t("go_term", [dict(term_nr=1, name="r", aspect="biological_process"), dict(term_nr=2, name="c", aspect="biological_process")]),
        "go_edge": t("go_edge", [dict(child=2, parent=1, relation="is_a")]),
        "go_annotation": t("go_annotation", [dict(entry_nr=1, term_nr=2, evidence="IDA", reference="R"), dict(entry_nr=1, term_nr=99, evidence="IDA", reference="R")]),
    }
    r = Release(spark, str(tmp_path))
    build.build(r, raw)
    assert rows(r.table("genome").select("species_code", "entry_off")) == [("AAAAA", 0), ("BBBBB", 3)]
    assert rows(r.table("entry").select("entry_nr", "group_nr", "hog_id", "canonical_id")) == [(1, 7, "HOG:E0000001", "T1"), (2, 0, "", ""), (3, 7, "HOG:E0000001", ""), (4, 7, "HOG:E0000001", "S4"), (5, 0, "HOG:E0000001", "")]
    assert rows(r.table("pairwise").select("entry_nr1", "rel_type")) == [(1, 2), (3, 2), (4, 5)]
    assert [x.confidence for x in r.table("pairwise").orderBy("entry_nr1").collect()][:2] == [-1.0, -1.0]
    assert rows(r.table("group_meta")) == [(7, "n/a", "", 3)]
    assert r.table("go_annotation").count() == 1
    assert rows(r.table("go_term_counts")) == [(1, 1), (2, 1)]
    assert {x.entry_nr: x.n_any for x in r.table("ortholog_counts").collect()} == {1: 3, 2: 0, 3: 3, 4: 3, 5: 3}
    build.build(r, raw, phases=("xrefs", "caches"))
    assert r.table("entry").count() == 5
    fm = build.family_metadata(r.table("entry"), frame([(1, "kinase")], "fam bigint, keywords string"))
    assert fm.first().keywords == "kinase"
    assert '"entry_nr":1' in fm.first().family_json
    assert build.missing_families(r.table("entry"), fm).count() == 0
    exons = frame([(1, 1, 9), (3, 1, 7)], "entry_nr bigint, start bigint, end bigint")
    assert rows(build.exon_length_problems(r.table("entry"), exons, r.table("sequence"))) == [(3, 7)]
    assert set(build.summaries(r.table("entry"), r.table("xref"), r.table("go_annotation"))) >= {"group_sizes", "importance", "chromosomes"}


def test_tree_profiles(frame):
    levels = frame([(1, "a", 1), (1, "a.1a", 2), (1, "a.1b", 2), (2, "b", 1), (2, "b", 3)], "fam int, hog_id string, taxid int")
    tree = frame([(1, 0), (2, 1), (3, 1)], "taxid int, parent_taxid int")
    assert rows(build.tree_profiles(levels, tree)) == [(1, 1, "presence"), (1, 2, "duplication"), (1, 2, "presence"), (1, 3, "loss"), (2, 1, "presence"), (2, 2, "loss"), (2, 3, "presence")]


def test_term_layout(frame):
    terms = frame([(1, "P"), (2, "P"), (3, "P"), (4, "F")], "term_nr bigint, aspect string")
    c = hierarchy.closure(frame([(2, 1), (3, 1)], "child bigint, parent bigint"), "child", "parent", terms, "term_nr")
    f = ontology.term_frequencies(frame([(1, 2), (2, 2), (3, 3), (4, 4)], "entry_nr bigint, term_nr bigint"), c, terms)
    out = enrichment.term_layout(terms, c, f).collect()
    assert {(r.aspect, r.term_nr) for r in out} == {("P", 1), ("P", 2), ("P", 3), ("F", 4)}
