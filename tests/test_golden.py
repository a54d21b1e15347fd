"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from phylolake.errors import AmbiguousId, InvalidId, InvalidTaxonomy, TooUnspecificQuery
from phylolake.functions import hogid, sequence, strings
from phylolake.operators import annotations, enrichment, graphops, groups, hierarchy, homoeology, idmap, joins, matches, ontology, relations, similarity, synteny
from phylolake.operators.sequences import local_alignment, substring_rows
from phylolake.sinks import writers
from phylolake.sources import orthoxml, text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


H = "HOG:A0002412"


@pytest.mark.parametrize(
    ("a", "b", "ortholog", "group"),
    [
        (".4a", ".5c", True, ""), (".4a", ".4b", False, ""), (".4a.6b", ".4a", True, ".4a"), (".14aa", ".14ab", False, ""), (".15aa", ".14aa", True, ""),
        (".15aa.8b", ".15aa.3a", True, ".15aa"), (".1a.4b.2c", ".1a.4a.2c", False, ".1a"), ("", "", True, ""), (".1a", ".14a", True, ""),
    ],
)
def test_pair_relation(frame, a, b, ortholog, group):
    df = frame([(H + a, H + b)], "a string, b string")
    assert df.select(hogid.are_orthologous("a", "b"), hogid.common_group("a", "b")).first() == (ortholog, H + group)


def test_pair_relation_of_other_families_and_nulls(frame):
    df = frame([(H, "HOG:A0002413"), (None, H), ("", H)], "a string, b string")
    assert [r[0] for r in df.select(hogid.are_orthologous("a", "b")).collect()] == [False, None, False]


def test_id_helpers(frame):
    assert hogid.lexicographic_range("HOG:001") == ("HOG:001", "HOG:002")
    assert hogid.lexicographic_range("HOG:001.1a.2b") == ("HOG:001.1a.2b", "HOG:001.1a.2c")
    df = frame([(7, "HOG:E0000007.1a.2b", "HOG:E0000007.1a.3c")], "f int, a string, b string")
    assert df.select(hogid.format_id("f", "E"), hogid.ancestor_ids("a"), hogid.common_prefix("a", "b"), hogid.release_letters("a"), hogid.depth("a")).first() == (
        "HOG:E0000007", ["HOG:E0000007", "HOG:E0000007.1a", "HOG:E0000007.1a.2b"], "HOG:E0000007.1a.", "E", 2,
    )


def test_orthology_type(frame):
    pairs = frame([(1, 5), (1, 6), (1, 10), (1, 20), (2, 5), (2, 6), (2, 10), (2, 11), (3, 12), (3, 21), (3, 22)], "e1 bigint, e2 bigint")
    offs = frame([("A", 0, 4), ("B", 4, 9), ("C", 9, 19), ("D", 19, 40)], "g string, lo bigint, hi bigint")
    with_g = joins.interval_join(joins.interval_join(pairs, offs, "e1", F.col("lo") + 1, F.col("hi"), width=8).withColumnRenamed("g", "g1").drop("lo", "hi"), offs, "e2", F.col("lo") + 1, F.col("hi"), width=8)
    got = relations.cardinality(with_g.withColumnRenamed("g", "g2"), "e1", "e2", ["g1"], ["g2"])
    labels = {(r.e1, r.e2): relations.REL_TYPES.index(r.rel_label) for r in got.collect()}
    assert [labels[(r.e1, r.e2)] for r in pairs.collect()] == [3, 3, 2, 0, 3, 3, 3, 1, 0, 1, 1]


@pytest.mark.parametrize(
    ("parent", "child", "events", "n"),
    [
        (["1", "2", "3", "4", "6.1a", "6.1b", "7.2c"], ["1", "2.1a", "4.1a", "4.1b", "5", "6.1a", "7.2c"],
         [("1", "retained"), ("2.1a", "duplicated"), ("3", "lost"), ("4.1a", "duplicated"), ("4.1b", "duplicated"), ("5", "gained"), ("6.1a", "retained"), ("6.1b", "lost"), ("7.2c", "retained")], 2),
        (["1.1a", "1.1b", "1.1c"], ["1.1a", "1.1c.4b"], [("1.1a", "retained"), ("1.1b", "lost"), ("1.1c.4b", "duplicated")], 1),
    ],
)
def test_level_events(frame, parent, child, events, n):
    p, c = (frame(["HOG:000000" + x for x in v], "hog_id string") for v in (parent, child))
    assert rows(groups.compare_levels(p, c)) == sorted(("HOG:000000" + h, e) for h, e in events)
    assert groups.duplication_events(p, c) == n


def test_ortholog_counts_equal_enumeration(frame):
    ids = ["", ".1a", ".1b", ".2a", ".1a.3a", ".1a.3b", ".1ab"]
    e = frame([(i + 1, i % 3, 1, "HOG:E0000001" + x, f"S{i % 4}") for i, x in enumerate(ids)] + [(8, 1, None, "", "S9")], "entry_nr bigint, group_nr int, fam int, hog_id string, species_code string")
    p = frame([(1, 2), (2, 1), (8, 3)], "entry_nr1 bigint, entry_nr2 bigint")
    got = {r[0]: tuple(r)[1:] for r in relations.ortholog_counts(p, e).collect()}
    data, pairs = e.collect(), {(a, b) for a, b in rows(p)} | {(b, a) for a, b in rows(p)}

    def ortho(a, b):
        x, y = a.split("."), b.split(".")
        for s, t in zip(x, y, strict=False):
            if s != t:
                return s.rstrip("abcdefghijklmnopqrstuvwxyz") != t.rstrip("abcdefghijklmnopqrstuvwxyz")
        return True

    for a in data:
        vp = {b.entry_nr for b in data if (a.entry_nr, b.entry_nr) in pairs}
        ho = {b.entry_nr for b in data if b.entry_nr != a.entry_nr and a.fam and b.fam and ortho(a.hog_id, b.hog_id)}
        hp = {b.entry_nr for b in data if b.entry_nr != a.entry_nr and a.fam and b.fam and not ortho(a.hog_id, b.hog_id)}
        gr = {b.entry_nr for b in data if b.entry_nr != a.entry_nr and a.group_nr and a.group_nr == b.group_nr}
        assert got[a.entry_nr] == (len(vp), len(ho), len(hp), len(gr), len(vp | ho | gr)), a


def test_tsv_pairs(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text("1\t1\t12421\t1:1\t0.99\t1.523\n2\t5\t21214\tn:1\t0.94\t12.14\n3\t5\t23552\tn:1\t0.91\t21.2\n")
    got = text.pairs_tsv(spark, str(f), offset2=100).orderBy("entry_nr1").collect()
    assert [(r.entry_nr1, r.entry_nr2, r.rel_type) for r in got] == [(1, 101, 0), (2, 105, 2), (3, 105, 2)]
    assert got[0].score == pytest.approx(124.21)
    turned = text.pairs_tsv(spark, str(f), offset1=10, swap=True).orderBy("entry_nr2").collect()
    assert [(r.entry_nr1, r.entry_nr2, r.rel_type) for r in turned] == [(1, 11, 0), (5, 12, 1), (5, 13, 1)]
    (tmp_path / "e.tsv").write_text("")
    assert text.pairs_tsv(spark, str(tmp_path / "e.tsv")).count() == 0


@pytest.mark.parametrize(
    ("locus", "n", "lo", "hi", "strand"),
    [
        ("422..522", 1, 422, 522, 1), ("complement(22..6232)", 1, 22, 6232, -1), ("join(23..15555,22432..66666)", 2, 23, 66666, 1),
        ("join(complement(23..15555),complement(22432..66666))", 2, 23, 66666, -1), ("join(Before(10)..40,33..After(66))", 2, 10, 66, 1),
        ("complement(join(1653679..1653924,1654352..1654354))", 2, 1653679, 1654354, -1),
        ("join(complement(351224..351421), complement(350585..350789), complement(350552))", 3, 350552, 351421, -1),
        ("join(complement(FromElsewhere('AO01.1',540..627)),complement(406..534))", 2, 406, 627, -1), ("", 0, None, None, None), (None, 0, None, None, None),
    ],
)
def test_loci(frame, locus, n, lo, hi, strand):
    e = frame([(locus,)], "l string").select(strings.exons("l")).first()[0]
    assert len(e) == n
    if n:
        assert (min(x.start for x in e), max(x.end for x in e), e[0].strand) == (lo, hi, strand)


def test_locus_text(frame):
    for strand, exp in ((1, "join(500..510, 600..610)"), (-1, "join(complement(600..610), complement(500..510))")):
        df = frame([([(500, 510, strand), (600, 610, strand)],)], "e array<struct<start:bigint,end:bigint,strand:int>>")
        assert df.select(strings.locus_text("e")).first()[0] == exp


def test_isoform_genes(frame):
    alt = [0, 2, 2, 0, 6, 6, 6, 10, 9, 10, 11, 10, 11]
    e = frame(list(enumerate(alt, 1)), "entry_nr bigint, alt_splice int")
    gene = F.coalesce(F.nullif("alt_splice", F.lit(0)).cast("bigint"), F.col("entry_nr"))
    got = {r.g: set(r.m) for r in e.groupBy(gene.alias("g")).agg(F.collect_list("entry_nr").alias("m")).collect()}
    assert got == {1: {1}, 2: {2, 3}, 4: {4}, 6: {5, 6, 7}, 10: {8, 10, 12}, 9: {9}, 11: {11, 13}}


def test_match_views(frame):
    m = frame([(1, 1, True, False, True), (1, 5, True, True, True), (1, 6, False, False, False), (2, 4, True, True, True), (2, 8, False, False, True), (5, 6, True, True, True)],
              "entry_nr1 bigint, entry_nr2 bigint, is_stable boolean, is_verified boolean, is_canonical boolean")
    one = m.where("entry_nr1 = 1")
    assert [r.entry_nr2 for r in matches.view(one, "SP").collect()] == [1, 5]
    assert [r.entry_nr2 for r in matches.view(one, "VP").collect()] == [5]
    new = matches.set_flag(m, frame([(1, 6)], "entry_nr1 bigint, entry_nr2 bigint"), "is_verified", entries=frame([1], "entry_nr bigint"))
    assert [(r.entry_nr1, r.entry_nr2) for r in new.where("is_verified").orderBy("entry_nr1").collect()] == [(1, 6), (2, 4), (5, 6)]
    with pytest.raises(KeyError):
        matches.set_flag(m, frame([(7, 7)], "entry_nr1 bigint, entry_nr2 bigint"), "is_stable")


def test_taxonomy_with_inner_species(frame):
    tree = frame([(10, 0, "Root"), (20, 10, "Outgroup"), (30, 10, "A"), (40, 30, "B")], "taxid int, parent_taxid int, name string")
    assert hierarchy.to_newick(tree, species={20: "OUTGR", 30: "HELLO", 40: "BBBBB"}) in ("((B,A_[disambiguate_HELLO])A,Outgroup)Root;", "(Outgroup,(B,A_[disambiguate_HELLO])A)Root;")
    assert hierarchy.to_nested(tree)["children"][0]["name"] == "A"
    assert hierarchy.to_phyloxml(tree).count("<clade>") == 4


def test_trees(frame):
    tree = frame([(1, 0, "r1"), (2, 1, "x"), (3, 2, "y"), (4, 3, "z"), (5, 3, "w"), (6, 0, "r2"), (-7, 6, "neg")], "taxid int, parent_taxid int, name string")
    single = hierarchy.with_single_root(tree)
    assert single.count() == 8
    assert single.where("name = 'LUCA'").first().parent_taxid == -1
    c = hierarchy.closure(single.where("parent_taxid >= 0"), "taxid", "parent_taxid", single, "taxid")
    assert rows(hierarchy.lineage(c, 4)) == [(0, 4), (1, 3), (2, 2), (3, 1), (4, 0)]
    assert {r.taxid for r in hierarchy.subtree(c, 3).collect()} == {3, 4, 5}
    assert {r.taxid for r in hierarchy.leaves(single).collect()} == {4, 5, -7}
    assert {r.taxid for r in hierarchy.leaves(single, also=frame([3], "taxid int")).collect()} == {3, 4, 5, -7}
    members = frame([4, 5, 2, 1, -7], "taxid int")
    assert dict(rows(hierarchy.induced_tree(c, members))) == {4: 2, 5: 2, 2: 1, 1: None, -7: None}
    collapsed = dict(rows(hierarchy.induced_tree(c, members, collapse=True)))
    assert collapsed == {4: 2, 5: 2, 2: None, -7: None}
    assert dict(rows(hierarchy.induced_tree(c, frame([4, 5], "taxid int"), with_ancestors=True, collapse=True))) == {4: 3, 5: 3, 3: None}
    order = [r.taxid for r in hierarchy.preorder(c, 1, tree).orderBy("idx").collect()]
    assert order == [1, 2, 3, 5, 4]


def test_cycles_raise(frame):
    for edges in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(InvalidTaxonomy):
            hierarchy.closure(frame(edges, "c int, p int"), "c", "p")
    assert hierarchy.closure(frame([(1, 1), (None, 2)], "c int, p int"), "c", "p").count() == 0


def test_group_file(spark):
    """Rows worked out by hand: one duplication with three copies, of which one is a group of its own."""
    path = "tests/data/groups.xml"
    g, genes = orthoxml.read_groups(spark, path), orthoxml.read_genes(spark, path)
    assert rows(genes) == sorted(
        [("101", 71, "Vega", None, "v1"), ("102", 71, "Vega", None, "v2"), ("103", 71, "Vega", None, "v3"), ("201", 72, "Lyra & co", None, "l<1"), ("301", 81, "Orion", None, "o1"), ("302", 81, "Orion", None, "o2")], key=repr
    )
    h = "HOG:B0000041"
    exp = [
        (41, h, "Stars", 0.75, -1, 5, True), (41, h, "Hunters", 1.0, -1, 1, False), (41, h, "Orion", 1.0, -1, 1, False),
        (41, h + ".1a", "Harp", 1.0, -1, 2, True), (41, h + ".1a", "Vega", 1.0, -1, 1, False), (41, h + ".1a", "Lyra & co", 1.0, -1, 1, False),
        (41, h + ".1b", "Harp", 0.5, -1, 1, True), (41, h + ".1b", "Vega", 1.0, -1, 1, False), (41, h + ".1c", "Harp", 0.5, -1, 1, True), (41, h + ".1c", "Vega", 1.0, -1, 1, False),
        (2, "HOG:B0000002", "Hunters", 1.0, -1, 1, True), (2, "HOG:B0000002", "Orion", 1.0, -1, 1, False),
    ]
    assert rows(orthoxml.hog_levels(g, genes, "B")) == sorted(exp, key=repr)
    for bad in ("a", "AB", " "):
        with pytest.raises(ValueError):
            orthoxml.hog_levels(g, genes, bad)
    assert rows(orthoxml.top_level_members(g)) == [(2, "Hunters", ["302"]), (41, "Stars", ["101", "102", "103", "201", "301"])]
    assert rows(orthoxml.gene_labels(g.where("fam = 41"), "B")) == [(41, "101", h + ".1a"), (41, "102", h + ".1b"), (41, "103", h + ".1c"), (41, "201", h + ".1a"), (41, "301", h)]
    docs = {r.fam: r.xml for r in orthoxml.split_families(g, genes).collect()}
    assert docs[2].count("<gene ") == 1
    assert docs[41].count("<gene ") == 5
    assert len(orthoxml.top_level_groups(docs[41])) == 1


def test_group_file_in_many_byte_ranges(spark, tmp_path):
    """A file of one line, read in small pieces, gives the same groups and genes as in one piece."""
    many = "".join(f'<orthologGroup id="{i}"><property name="TaxRange" value="T"/><paralogGroup><geneRef id="{i}"/><geneRef id="{i + 1}"/></paralogGroup></orthologGroup>' for i in range(1, 400))
    lists = "".join(f'<species name="s{k}" NCBITaxId="{k}"><database><genes>{"".join(f"<gene id={chr(34)}{i}{chr(34)}/>" for i in range(k * 50, k * 50 + 50))}</genes></database></species>' for k in range(8))
    f = tmp_path / "one.xml"
    f.write_text(f"<orthoXML>{lists}<groups>{many}</groups></orthoXML>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        g, genes = orthoxml.read_groups(spark, str(f)), orthoxml.read_genes(spark, str(f))
        assert g.count() == 399
        assert rows(g.select("fam")) == sorted([(i,) for i in range(1, 400)], key=repr)
        assert {r.xml.count("<orthologGroup") for r in g.collect()} == {1}
        assert {(int(r.gene_ref) // 50 == r.taxid, r.species == f"s{r.taxid}") for r in genes.collect()} == {(True, True)}
        assert genes.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ENTRIES = """<E><ID>ENSG00000204640</ID><AC>ENSP00000366061; ENST00000376865</AC><DE>hypothetical</DE><GI>125233342</GI><UniProt/TrEMBL>P21522</UniProt/TrEMBL></E>
<E><ID>BLA22; BLABLA22.Rep22</ID><AC>BLA22.1</AC><EC>3.2.2.-; 4.2.99.18</EC><EntrezGene>32244</EntrezGene><SMR>P21122; Q24S32</SMR><GO>GO:0006270@[[IDA,{'PMID:2167836'}],[IEA,{'R:002','R:020'}]]; GO:0006275@[[IEA,{'R:002'}]]</GO></E>
<E><UniProt/TrEMBL>L8ECQ9_BACSU</UniProt/TrEMBL><SwissProt_AC>Q6CI62</SwissProt_AC><SwissProt>ASF1_YARLI</SwissProt><ID>FBgn0218776</ID><GO></GO></E>
"""


def test_tagged_entries(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_text(ENTRIES)
    tags = text.entry_lines(spark, str(f))
    x = {tuple(r) for r in text.entry_xrefs(tags).collect()}
    assert {(1, "GI", "125233342", 0), (3, "UniProtKB/SwissProt", "ASF1_YARLI", 0), (2, "Swiss Model", "P21122", 2), (2, "Swiss Model", "Q24S32", 2), (1, "Ensembl Gene", "ENSG00000204640", 0),
            (3, "UniProtKB/TrEMBL", "L8ECQ9", 0), (3, "UniProtKB/TrEMBL", "Q6CI62", 0), (3, "FlyBase", "FBgn0218776", 0), (2, "SourceID", "BLABLA22", 0)} <= x
    assert rows(text.entry_ec(tags)) == [(2, "3.2.2.-"), (2, "4.2.99.18")]
    assert rows(text.entry_go(tags)) == [(2, 6270, "IDA", "PMID:2167836"), (2, 6270, "IEA", "R:002"), (2, 6270, "IEA", "R:020"), (2, 6275, "IEA", "R:002")]
    assert rows(text.entry_descriptions(tags)) == [(1, "hypothetical")]


OBO = """format-version: 1.2

[Term]
id: GO:0000003
name: reproduction
namespace: biological_process
alt_id: GO:0019952
def: "Making \\"new\\" ones." [x]
is_a: GO:0008150 ! biological_process
relationship: part_of GO:0000009 ! z

[Term]
id: GO:0003822
name: obsolete thing
is_obsolete: true

[Term]
id: GO:0008150
name: biological_process
namespace: biological_process

[Typedef]
id: part_of
"""


def test_ontology_file(spark, tmp_path):
    f = tmp_path / "o.obo"
    f.write_text(OBO)
    terms, edges = text.obo(spark, str(f))
    assert rows(terms.select("term_nr", "name", "alt_ids")) == [(3, "reproduction", [19952]), (8150, "biological_process", [])]
    assert rows(edges) == [(3, 8150, "is_a"), (3, 9, "part_of")]


def test_other_files(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">p1 first one\nACD\nEF\n>p2\nKL\n")
    assert rows(text.fasta(spark, str(tmp_path / "s.fa"))) == [("p1", "first one", "ACDEF"), ("p2", "", "KL")]
    m = "0" * 32
    (tmp_path / "d.csv").write_text(f"{m},PF00001,1-20,30-40\nnonsense\n")
    assert rows(text.domains(spark, str(tmp_path / "d.csv"))) == [(m, "PF00001", "1:20:30:40")]
    (tmp_path / "n.txt").write_text("# c\n1.10.8.10  1abcA00  :Helicase\nPF00002\tx\ty\tz\tSeven helices\n")
    assert rows(text.domain_names(spark, str(tmp_path / "n.txt"))) == [("1.10.8.10", "CATH/Gene3D", "Helicase"), ("PF00002", "Pfam", "Seven helices")]
    (tmp_path / "a.gaf").write_text("!gaf-version: 2.1\nDB\tP1\tp\t\tGO:0000003\tR:1\tIDA\n")
    assert text.gaf(spark, str(tmp_path / "a.gaf")).select("DB_Object_ID", "term_nr", "Evidence", "Taxon_ID").first() == ("P1", 3, "IDA", None)


def test_sinks_round_trip(spark, frame, tmp_path):
    df = frame([(1, "a"), (2, None)], "k int, v string")
    writers.save_table(df, str(tmp_path / "t"), mode="overwrite")
    writers.append_rows(spark, str(tmp_path / "t"), frame([("z", 3)], "v string, k int"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    with pytest.raises(ValueError):
        writers.append_rows(spark, str(tmp_path / "t"), frame([1], "other int"))
    assert rows(writers.replace_column(df, frame([(1, "new")], "k int, v string"), ["k"], "v", "n/a")) == [(1, "new"), (2, "n/a")]
    with pytest.raises(ValueError):
        writers.replace_column(df, frame([(1, "x"), (1, "y")], "k int, v string"), ["k"], "v", "")
    writers.write_tsv(df, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 2
    gaf = frame([tuple("abcdefghijklmnopq")], ", ".join(f"`{c}` string" for c in annotations.GAF_COLUMNS)).coalesce(1)
    writers.write_gaf(gaf, str(tmp_path / "gaf"))
    assert text.gaf(spark, str(tmp_path / "gaf")).first()["DB"] == "a"
    links = writers.linkout_records(frame([(1, "x & y", None)], "object_id int, query string, url_part string"), provider="7", base_url="https://b/", database="Protein")
    assert "x &amp; y" in links.first()["xml"]


def test_graph_edits():
    g = graphops.contract_parentless(graphops.Graph([("A", "b", 1), ("b", "c", 1), ("c", "D", 2), ("D", "E", 1)]), {"b", "c"})
    assert [e[:2] for e in g.edges()] == [("A", "D"), ("D", "E")]
    star = [(0, 1, 4), (1, 9, 5)] + [(1, x, 1) for x in range(2, 8)]
    assert graphops.drop_weak_edges(graphops.Graph(star), 3).edges() == [(0, 1, 4), (1, 9, 5)]
    assert len(graphops.drop_weak_edges(graphops.Graph(star), 5, 5).edges()) == 8
    fork = graphops.resolve_forks(graphops.Graph([("a", "i", 5), ("i", "j", 2), ("j", "b", 5), ("i", "k", 3), ("k", "j", 3)]))
    assert fork.edges() == [("a", "i", 5), ("b", "j", 5), ("i", "k", 5), ("j", "k", 5)]


def test_graph_clean_up_runs_per_component(frame):
    e = frame([(1, 2, 20), (2, 3, 20), (10, 11, 5), (11, 12, 7)], "node1 bigint, node2 bigint, weight int")
    got = rows(graphops.clean_graph(e, frame([11], "node bigint")))
    assert got == [(1, 2, 20.0), (10, 12, 7.0), (2, 3, 20.0)]
    assert rows(graphops.component_labels(e)) == [(1, 1), (10, 10), (11, 10), (12, 10), (2, 1), (3, 1)]


def test_edges_propagate_to_the_root(frame):
    e = frame([("a1", "b1", 1), ("a2", "b1", 2), ("b1", "c1", 1)], "node1 string, node2 string, weight int")
    up = [frame([("A", "R"), ("B", "S"), ("C", "S")], "node string, parent string"), frame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "node string, parent string")]
    got = rows(synteny.propagate_edges(e, up))
    assert [r for r in got if r[0] < 2] == [(0, "R", "S", 3), (1, "A", "B", 3), (1, "B", "C", 1)]


def test_sequences(frame):
    df = frame([("GCGAATAT",), ("",), ("xx-1",)], "s string")
    assert [r[0] for r in df.select(sequence.gc_content("s")).collect()] == [3 / 8, 0.0, 0.0]
    assert df.select(sequence.sanitise("s")).collect()[2][0] == "XX"
    assert df.select(sequence.kmers("s", 6)).first()[0] == ["GCGAAT", "CGAATA", "GAATAT"]
    w = frame([("ACDYY",), ("B",)], "s string")
    code = w.select(sequence.kmer_code("s")).collect()
    assert code[1][0] is None
    assert w.withColumn("c", sequence.kmer_code("s")).select(sequence.kmer_word("c", 5)).first()[0] == "ACDYY"
    assert frame([("AC-T", "AGGT")], "a string, b string").select(sequence.identity("a", "b")).first()[0] == pytest.approx(2 / 3)
    assert local_alignment("ACDEFGHIKL", "ACDEFGHIKL") == (pytest.approx(57 * 5 * math.log10(2)), 1.0)  # 57 half bits
    assert local_alignment("", "A") == (0.0, 0.0)
    t = frame([("banana",), ("ananana",), ("",), (None,)], "t string")
    assert [r.occurrences for r in substring_rows(t, "t", "ANA").collect()] == [2, 3]
    assert substring_rows(t, "t", "").count() == 0


def test_identifier_resolution(frame):
    e = frame([(1, 0, "YEAST"), (2, 2, "YEAST"), (3, 2, "YEAST"), (4, 0, "SCHPO")], "entry_nr bigint, alt_splice int, species_code string")
    x = frame([(1, 0, "P12345", 0), (2, 10, "Q1.2", 0), (3, 10, "Q1.1", 0), (4, 110, "abc", 2), (1, 110, "ABC", 4)], "entry_nr bigint, source int, xref_id string, verification int")
    assert idmap.resolve("4", e, x) == 4
    assert idmap.resolve("p12345", e, x) == 1
    assert idmap.resolve("q1", e, x) == 2
    with pytest.raises(AmbiguousId):
        idmap.resolve("abc", e, x)
    with pytest.raises(InvalidId):
        idmap.resolve("nothing", e, x)
    with pytest.raises(TooUnspecificQuery):
        idmap.search(x, "1", "suffix", unspecific=1)
    assert idmap.search(x, "", "prefix").count() == 0
    assert rows(idmap.reduce_xrefs(x, e).select("gene", "xref", "entry_nr")) == [(1, "abc", 1), (1, "p12345", 1), (2, "q1", 2), (4, "abc", 4)]
    assert [m.name for m in idmap.MAPPERS.values()][0] == "all"
    assert idmap.mapper("uniprot").rows(x).count() == 3


def test_enrichment_matches_the_exact_test(frame):
    def tail(a, n, k, total):
        return sum(math.comb(k, x) * math.comb(total - k, n - x) for x in range(a, min(n, k) + 1)) / math.comb(total, n)

    ann = frame([(i, 1) for i in range(1, 9)] + [(i, 2) for i in range(5, 21)], "entry_nr bigint, term_nr bigint")
    study = frame([1, 2, 3, 5, 99], "entry_nr bigint")
    c = frame([(1, 1, 0), (2, 2, 0)], "descendant bigint, ancestor bigint, dist bigint")
    got = {r.term_nr: r for r in enrichment.enrichment(ann, study, c).collect()}
    assert got[1].p == pytest.approx(tail(4, 4, 8, 20))
    assert got[2].p == pytest.approx(tail(1, 4, 16, 20))
    assert got[1].p_fdr == pytest.approx(min(1, got[1].p * 2))
    assert got[1].p_bonferroni == pytest.approx(got[1].p * 2)


def test_term_similarity(frame):
    terms = frame([(1, "P"), (2, "P"), (3, "P"), (4, "F")], "term_nr bigint, aspect string")
    edges = frame([(2, 1), (3, 1)], "child bigint, parent bigint")
    c = hierarchy.closure(edges, "child", "parent", terms, "term_nr")
    f = ontology.term_frequencies(frame([(1, 2), (2, 2), (3, 3), (3, 3), (4, 4)], "entry_nr bigint, term_nr bigint"), c, terms)
    assert rows(f.select("term_nr", "n", "total")) == [(1, 3, 3), (2, 2, 3), (3, 1, 3), (4, 1, 1)]
    s = {(r.t1, r.t2): (r.lca, r.lin) for r in ontology.pair_similarity(frame([(2, 3), (2, 2), (2, 4)], "t1 bigint, t2 bigint"), c, f).collect()}
    assert s[(2, 3)][0] == 1
    assert s[(2, 3)][1] == pytest.approx(0)
    assert s[(2, 2)] == (2, pytest.approx(1))
    assert s[(2, 4)] == (None, 0)


def test_annotation_helpers(frame):
    df = frame([("GO:0000003",), ("17",), ("GO:12345678",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(ontology.term_number("t")).collect()] == [3, 17, None, None, None]
    c = frame([("1:10:21:30",), ("5:5",), ("",), (None,)], "c string")
    assert [r[0] for r in c.select(annotations.segment_length("c")).collect()] == [20, 1, 0, None]
    h = frame([0.0, 0.01, 1.0, 0.02, None], "x double")
    assert rows(annotations.histogram(h, "x").select("bin", "n")) == [(0, 1), (1, 1), (49, 1)]


def test_forward_map(frame):
    old = frame([("A", x) for x in "abcd"] + [("B", x) for x in "xyz"] + [("C", x) for x in "klmnopqrst"], "hog_id string, member string")
    new = frame([("N", x) for x in "abcd"] + [("M", x) for x in "xyzw"] + [("O", x) for x in "xy"] + [("P", "k")], "hog_id string, member string")
    assert [(r[0], r[1], round(r[2], 3)) for r in rows(similarity.forward_map(old, new))] == [("A", "N", 1.0), ("B", "M", 0.75), ("B", "O", 0.667)]


def test_mds_recovers_a_line(frame):
    pairs = frame([(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 1, 3, 3.0)], "g int, a int, b int, d double")
    nodes = frame([(1, 1), (1, 2), (1, 3), (2, 9)], "g int, node int")
    got = {r.node: r.x0 for r in similarity.mds_layout(pairs, nodes, group="g", node="node", a="a", b="b", distance="d", dimensions=1).collect()}
    assert abs(got[1] - got[3]) == pytest.approx(3)
    assert abs(got[1] - got[2]) == pytest.approx(1)
    assert got[9] == 0


def test_confidence_orders_pairs(frame):
    p = frame([(1, 2, 1.0, 1.0, 2), (3, 4, 100.0, 0.0, 12), (5, 6, None, None, None), (7, 8, 30.0, 0.4, 4)], "entry_nr1 int, entry_nr2 int, distance double, synteny double, copy_nr int")
    got = {r.entry_nr1: r.confidence for r in homoeology.homoeolog_confidence(p).collect()}
    assert got[1] == pytest.approx(100)
    assert got[3] < got[7] < got[1]
    assert homoeology.homoeolog_confidence(p.where("false")).count() == 0


def test_interval_helpers(frame):
    a = frame([("c", 1, 100, "x"), ("c", 150, 160, "y"), ("d", 1, 5, "z")], "chr string, s1 int, e1 int, n1 string")
    b = frame([("c", 90, 155, "p"), ("c", 161, 170, "q"), ("d", 5, 9, "r"), ("d", 9, 5, "bad")], "chr string, s2 int, e2 int, n2 string")
    assert rows(joins.overlap_join(a, b, ["chr"], ("s1", "e1"), ("s2", "e2"), width=20).select("n1", "n2")) == [("x", "p"), ("y", "p"), ("z", "r")]
    left = frame([(5,), (0,), (10,), (None,)], "k int")
    right = frame([(1, "a"), (5, "b"), (9, "c")], "r int, v string")
    for width in (1, 2, 4, 100):
        assert rows(joins.asof_join(left, right, "k", "r", "v", width=width)) == [(0, None), (10, "c"), (5, "b"), (None, None)]
    both = joins.asof_join(frame([("x", 5), ("y", 5)], "g string, k int"), frame([("x", 1, "a")], "g string, r int, v string"), "k", "r", "v", width=3, by=["g"])
    assert rows(both) == [("x", 5, "a"), ("y", 5, None)]


def test_string_functions(frame):
    df = frame([("CamelCaseName", "P1.2", "A; Rep1; B.Rep3", "X_Y", "Salmonella enterica subsp. arizonae")], "a string, b string, c string, d string, e string")
    got = df.select(strings.snake_case("a"), strings.without_version("b"), strings.id_list("c"), strings.before_species_suffix("d"), strings.species_part("e"), strings.strain_part("e")).first()
    assert tuple(got) == ("camel_case_name", "P1", ["A", "B"], "X", "Salmonella enterica", "subsp. arizonae")
    n = frame(["Escherichia coli O157:H7", "Homo sapiens", None], "n string").select(strings.species_part("n"), strings.strain_part("n")).collect()
    assert [tuple(r) for r in n] == [("Escherichia coli", "O157:H7"), ("Homo sapiens", ""), (None, None)]
    d = frame(["2020-03-04", "04-Mar-2020", "20200304", "soon", None], "d string")
    assert [str(r[0]) for r in d.select(strings.any_date("d")).collect()] == ["2020-03-04", "2020-03-04", "2020-03-04", "None", "None"]
    p = frame(["YEAST00012", "yeast00012", "Y", None], "p string")
    code, nr = strings.protein_id_parts("p")
    assert [tuple(r) for r in p.select(code, nr).collect()] == [("YEAST", 12), ("YEAST", 12), (None, None), (None, None)]


def test_pair_files_spell_types_as_single_files(spark, tmp_path):
    folder = tmp_path / "pairs"
    folder.mkdir()
    (folder / "AAAAA-BBBBB.txt").write_text("1\t1\t12421\t1:1\t0.99\t1.523\n2\t5\t21214\tn:1\t0.94\t12.14\n3\t5\t23552\tn:m\t0.91\t21.2\n4\t6\t100\t1:n\t0.9\t1\n")
    genomes = spark.createDataFrame([("AAAAA", 0), ("BBBBB", 100)], "species_code string, entry_off bigint")
    got = rows(text.pair_files(spark, [str(folder)], genomes, both_ways=True).select("entry_nr1", "entry_nr2", "rel_type"))
    assert got == sorted([(1, 101, 0), (2, 105, 2), (3, 105, 3), (4, 106, 1), (101, 1, 0), (105, 2, 1), (105, 3, 3), (106, 4, 2)], key=repr)


def test_mappers_accept_and_rank_as_named(spark):
    x = spark.createDataFrame([(1, 110, "name", 2), (1, 0, "P1", 0), (1, 10, "P2", 4), (2, 95, "src", 0), (2, 0, "P3", 4), (2, 10, "P4", 0), (3, 105, "h", 4)], "entry_nr bigint, source int, xref_id string, verification int")
    assert rows(idmap.mapper("gene_name_or_symbol").best(x)) == [(1, 110, "name"), (2, 10, "P4")]
    assert {r.xref_id for r in idmap.mapper("uniprot").rows(x).collect()} == {"P1", "P2", "P3", "P4"}
    assert {r.xref_id for r in idmap.mapper("linkout").rows(x).collect()} == {"P1", "P2", "P3", "P4"}
    assert {r.xref_id for r in idmap.mapper("no_approximate").rows(x).collect()} == {"name", "P1", "src", "P4"}
    assert rows(idmap.best_per_entry(x)) == [(1, 0, "P1"), (2, 0, "P3"), (3, 105, "h")]


def test_exchange_matrix_is_that_published():
    """Symmetric, and with the published ungapped parameter (lambda 0.3176) under the usual residue frequencies."""
    import math

    from phylolake.operators import sequences as Q

    freq = dict(A=.07805, C=.01925, D=.05364, E=.06295, F=.03856, G=.07377, H=.02199, I=.05142, K=.05744, L=.09019, M=.02243, N=.04487, P=.05203, Q=.04264, R=.05129, S=.07120, T=.05841, V=.06441, W=.01330, Y=.03216)
    m = Q._exchange() / Q.UNIT
    assert (m == m.T).all()
    assert abs(sum(freq[a] * freq[b] * math.exp(0.3176 * m[ord(a), ord(b)]) for a in freq for b in freq) - 1) < 1e-3
    score, identity = Q.local_alignment("MKTAYIAKQR", "MKTAYIAKQR")
    assert identity == 1
    assert abs(score - sum(m[ord(a), ord(a)] for a in "MKTAYIAKQR") * Q.UNIT) < 1e-9


def test_tail_of_the_hypergeometric_distribution(spark):
    from math import comb

    from phylolake.operators.enrichment import hypergeometric_tail

    cases = [(1, 5, 7, 30), (0, 5, 7, 30), (5, 5, 7, 30), (3, 20, 18, 30), (8, 20, 18, 30), (2, 2, 2, 2), (40, 300, 900, 5000), (6, 5, 7, 30)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "term_nr bigint, a bigint, n bigint, k bigint, total bigint")
    got = {r.term_nr: r.p for r in hypergeometric_tail(df).collect()}
    for i, (a, n, k, t) in enumerate(cases):
        exact = sum(comb(k, x) * comb(t - k, n - x) for x in range(max(a, 0), min(n, k) + 1) if n - x <= t - k) / comb(t, n)
        assert got[i] == pytest.approx(exact, rel=1e-9, abs=1e-15)


def test_text_index(spark, tmp_path):
    from phylolake.operators.textindex import TextIndex

    docs = spark.createDataFrame([(1, "Orthologs of mice"), (2, "ORTHO logs"), (3, None), (4, ""), (5, "of"), (6, "mice and men " * 3000), (6, "again")], "id bigint, gram string")
    index = TextIndex(str(tmp_path / "ix"), buckets=4).build(docs, "id", "gram")
    find = lambda q: sorted((r.id for r in index.find(docs, "id", "gram", q).collect()))
    assert find("ortho") == [1, 2]
    assert find("mice") == [1, 6]
    assert find("of") == [1, 5]
    assert find("") == find("absent") == []
    index.build(spark.createDataFrame([(7, "more orthologs")], "id bigint, gram string"), "id", "gram", mode="append")
    assert sorted(r.id for r in index.candidates(spark, "logs").collect()) == [1, 2, 7]
    wanted = spark.createDataFrame([("ort",), ("zzz",)], "gram string")
    assert rows(index.words(spark, wanted)) == [("ort", 1), ("ort", 2), ("ort", 7)]


def test_a_cluster_needs_a_shared_folder():
    from phylolake.errors import NoSharedFolder
    from phylolake.session import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://somewhere:7077", "x"

    with pytest.raises(NoSharedFolder):
        shared_dir(Session)
