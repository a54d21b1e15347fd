import pytest
from pyspark.sql import functions as F

from phylolake.api import Release
from phylolake.errors import InvalidId, SchemaVersionError, Singleton, TooUnspecificQuery, UnknownLevel, UnknownSpecies
from phylolake.models import AncestralGenome, Exon, ExonStructure, PairwiseRelation
from phylolake.operators import orphans, scans, search
from phylolake.plans import catalogue
from phylolake.schemas import TABLES
from phylolake.streaming.incremental import OrphanMonitor, session_counts, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def release(spark):
    def t(name, data):
        cols = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
        return spark.createDataFrame([tuple(d.get(c) for c in cols) for d in data], TABLES[name])

    genomes = [dict(species_code=c, taxid=x, entry_off=o, tot_entries=4, sci_name=n) for c, x, o, n in (("AAAAA", 11, 0, "Alpha one"), ("BBBBB", 12, 4, "Beta two serovar X1"), ("CCCCC", 21, 8, "Gamma three"))]
    taxonomy = [dict(taxid=x, parent_taxid=p, name=n) for x, p, n in ((1, 0, "Root"), (10, 1, "Left"), (20, 1, "Right"), (11, 10, "AAAAA"), (12, 10, "BBBBB"), (21, 20, "CCCCC"))]
    hogs = {1: "HOG:E0000001", 2: "HOG:E0000001.1a", 5: "HOG:E0000001.1b", 6: "HOG:E0000001", 9: "HOG:E0000001.1a.2b", 10: "HOG:E0000002"}
    entry = []
    for nr in range(1, 13):
        g = genomes[(nr - 1) // 4]
        h = hogs.get(nr, "")
        entry.append(dict(entry_nr=nr, species_code=g["species_code"], taxid=g["taxid"], group_nr=nr % 3, hog_id=h, fam=int(h[5:12]) if h else None, chromosome="1", locus_start=nr * 100, locus_end=nr * 100 + 50, strand=1, alt_splice={3: 3, 4: 3}.get(nr, 0)))
    level = [dict(fam=1, hog_id=h, level=lv, is_root=r) for h, lv, r in (("HOG:E0000001", "Root", True), ("HOG:E0000001.1a", "Left", True), ("HOG:E0000001.1b", "Left", True), ("HOG:E0000002", "Right", True))]
    tables = {
        "genome": t("genome", genomes), "taxonomy": t("taxonomy", taxonomy), "entry": t("entry", entry), "hog_level": t("hog_level", level),
        "pairwise": t("pairwise", [dict(entry_nr1=a, entry_nr2=b, rel_type=r) for a, b, r in ((1, 5, 0), (1, 6, 1), (2, 9, 4), (1, 2, 5))]),
        "xref": t("xref", [dict(entry_nr=1, source=0, xref_id="P00001", verification=0), dict(entry_nr=9, source=110, xref_id="abc", verification=2)]),
        "go_term": t("go_term", [dict(term_nr=n, name=str(n), aspect="biological_process") for n in (1, 2)]), "go_edge": t("go_edge", [dict(child=2, parent=1, relation="is_a")]),
        "go_annotation": t("go_annotation", [dict(entry_nr=e, term_nr=n, evidence="IDA", reference="R") for e, n in ((1, 2), (2, 2), (5, 1), (9, 7))]),
        "sequence": t("sequence", [dict(entry_nr=1, seq="ACDEFGHIKLMNPQRSTVWYACDEFGHIKL", cdna="GCGAATAT", description="kinase of the membrane")]),
        "exon": t("exon", [dict(entry_nr=1, start=1, end=5, strand=-1), dict(entry_nr=1, start=9, end=12, strand=-1)]),
        "hog_map": t("hog_map", [dict(old_id="HOG:D0000009", new_id="HOG:E0000001", jaccard=0.9, dubious=False)]),
        "ancestral_synteny": t("ancestral_synteny", [dict(taxid=1, node1=a, node2=b, weight=w, evidence=e) for a, b, w, e in (("a", "b", 1.0, 1), ("b", "c", 2.0, 2), ("c", "d", 1.0, 2), ("a", "z", 1.0, 4))]),
    }
    return Release(spark, tables=tables)


def test_lookups(release):
    assert release.genome("aaaaa").taxid == 11
    assert release.genome(12).species_and_strain == ("Beta two", "serovar X1")
    assert release.genome("Gamma three").kingdom == "Root"
    with pytest.raises(UnknownSpecies):
        release.genome("nobody")
    assert release.protein_id(6) == "BBBBB00002"
    assert release.entry_of_protein_id("bbbbb00002") == 6
    with pytest.raises(InvalidId):
        release.entry_of_protein_id("BBBBB00009")
    with pytest.raises(InvalidId):
        release.entry(99)
    p = release.entry(4)
    assert (p.main_isoform, p.is_main_isoform, p.alternative_isoforms, p.hog_family_nr) == (3, False, [3], 0)
    one = release.entry(1)
    assert one.gc_content == 3 / 8
    assert str(one.exons) == "join(complement(9..12), complement(1..5))"
    assert release.resolve("p00001").entry_nr == 1
    assert release.main_isoforms("AAAAA").count() == 3
    assert rows(release.neighbours(2, 1).select("entry_nr", "offset")) == [(1, -1), (2, 0), (3, 1)]


def test_relations(release):
    assert release.orthologs(1).count() == 2
    assert release.homoeologs(1).count() == 1
    assert release.pairs_between("AAAAA", "BBBBB").count() == 2
    assert rows(release.induced_orthologs("AAAAA", "BBBBB").select("entry_nr1", "entry_nr2", "rel_label")) == [(1, 5, "1:n"), (1, 6, "m:n"), (2, 6, "m:1")]
    assert rows(release.induced_partners(2, orthologs=False).select("entry_nr", "common_id")) == [(5, "HOG:E0000001")]
    with pytest.raises(Singleton):
        release.induced_partners(7)
    r = PairwiseRelation(release, release.pairs(1, [1]).first())
    assert (r.rel_label, r.ends[1].entry_nr) == ("1:n", 6)


def test_set_based_equals_entry_by_entry(release):
    a, b = (release.genome(g).row for g in ("AAAAA", "BBBBB"))
    loop = [tuple(r) for nr in range(a.entry_off + 1, a.entry_off + a.tot_entries + 1) for r in release.pairs(nr).where(F.col("entry_nr2").between(b.entry_off + 1, b.entry_off + b.tot_entries)).collect()]
    assert sorted(loop, key=repr) == rows(release.pairs_between("AAAAA", "BBBBB"))
    mains = [r.entry_nr for r in release.main_isoforms("AAAAA").where("hog_id <> ''").collect()]
    one_by_one = {(nr, r.entry_nr) for nr in mains for r in release.induced_partners(nr).where("species_code = 'BBBBB'").collect()}
    assert one_by_one == {(r.entry_nr1, r.entry_nr2) for r in release.induced_orthologs("AAAAA", "BBBBB").collect()}


def test_groups(release):
    assert [r.entry_nr for r in release.hog_members("HOG:E0000001.1a").orderBy("entry_nr").collect()] == [2, 9]
    assert [r.entry_nr for r in release.hog_members("HOG:E0000001.1a", "Left").collect()] == [2]
    with pytest.raises(UnknownLevel):
        release.hog_members("HOG:E0000001.1a", "Right")
    assert release.hog("HOG:E0000001").nr_members == 5
    assert rows(release.hogs_at_level("Left", "Root")) == [("HOG:E0000001.1a", "duplicated"), ("HOG:E0000001.1b", "duplicated")]
    assert release.subhogs("HOG:E0000001", "Root").count() == 2
    assert [r.parent_id for r in release.parent_hogs("HOG:E0000001.1a", 11).collect()] == ["HOG:E0000001", "HOG:E0000001.1a"]
    assert AncestralGenome(release, release.taxonomy.where("taxid = 10").first()).extant_genomes == ["AAAAA", "BBBBB"]
    assert release.newick() == "((AAAAA,BBBBB)Left,(CCCCC)Right)Root;"
    assert release.map_hog("HOG:D0000009").first().new_id == "HOG:E0000001"
    assert rows(release.syntenic_hogs(1, "a", steps=2).select("node1", "node2")) == [("a", "b"), ("b", "c")]
    assert rows(release.neighbour_hogs(1, "a")) == [("b", 1.0), ("z", 1.0)]


def test_annotations(release):
    assert release.go(1, 10).count() == 3
    assert release.gaf(1).first()["DB_Object_ID"] == "AAAAA00001"
    assert release.entries_with_go("GO:0000002").count() == 2
    with pytest.raises(InvalidId):
        release.entries_with_go("x")
    e = release.enrichment_of_genome("AAAAA", release.table("entry").where("entry_nr = 1"), alpha=None)
    assert {r.term_nr for r in e.collect()} == {2}
    with pytest.raises(ValueError):
        release.enrichment_of_genome("AAAAA", release.table("entry").where("entry_nr = 9"))


def test_search(release):
    def found(*tokens, **kw):
        return sorted(r.entry_nr for r in release.search(list(tokens), **kw).entries.collect())

    assert found(search.HogToken("E0000001")) == [1, 2, 5, 6, 9]
    assert found(search.HogToken("HOG:D0000009"), search.TaxToken("Left")) == [1, 2, 5, 6]
    assert found(search.HogToken("E0000001"), search.TaxToken("AAAAA"), search.GOToken("1")) == [1, 2]
    assert found(search.TaxToken("Leftt")) == list(range(1, 9))
    assert found(search.GroupToken("group 2"), search.TaxToken("21")) == [11]
    assert found(search.XRefToken("p000")) == [1]
    assert found(search.SequenceToken("DEFGHIKLMN")) == [1]
    assert found(search.SequenceToken("DE")) == []
    assert found(search.TaxToken("Left"), entry_limit=3) == [1, 2, 3]
    assert rows(release.search_protein("kinase")) == [(1, "description")]


def test_scans(release):
    e = release.table("entry")
    assert scans.read_where(e, "entry_nr = :nr", {"nr": 3}, "alt_splice").first()[0] == 3
    assert scans.read_where(e, "entry_nr > 99", field="entry_nr").columns == ["entry_nr"]
    assert [r.entry_nr for r in scans.page(e, ["entry_nr"], 1, 9, 3).orderBy("entry_nr").collect()] == [2, 5, 8]
    assert [len(c) for c in scans.chunks(e.coalesce(1), 5)] == [5, 5, 2]
    assert scans.count_values(e, "entry_nr", 2, 4) == 3
    with pytest.raises(KeyError):
        scans.count_values(e, "nope", 1)


def test_versions(spark):
    def meta(v):
        return {"metadata": spark.createDataFrame([("schema_version", v)], TABLES["metadata"])}

    assert Release(spark, tables=meta("3.9")).table("entry").count() == 0
    with pytest.raises(SchemaVersionError):
        Release(spark, tables=meta("2.1"))
    with pytest.raises(KeyError):
        Release(spark).table("nope")
    assert issubclass(TooUnspecificQuery, Exception)


def test_saved_tables(spark, release, tmp_path):
    r = Release(spark, str(tmp_path))
    r.save("entry", release.table("entry"))
    assert r.table("entry").count() == 12
    assert r.proteins_of.__self__ is r
    plan = r.table("entry").where("species_code = 'AAAAA'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(species_code" in plan


def test_exon_models():
    ex = ExonStructure([Exon(500, 510), Exon(600, 610)])
    assert (len(ex), str(ex), ex.as_list_of_dict()[1]) == (2, "join(500..510, 600..610)", {"start": 600, "end": 610, "strand": "+"})


def test_orphan_monitor(spark, frame, tmp_path):
    src, schema = tmp_path / "in", "space string, period int, key bigint, refs bigint, present bigint"
    frame([("e", 1, 5, 1, 0), ("e", 1, 6, 1, 0)], schema).write.parquet(str(src / "a"))
    m = OrphanMonitor(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    m.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(m.report()) == [("e", 1, 2, 2)]
    frame([("e", 1, 5, 0, 1), ("e", 2, 7, 1, 0)], schema).write.parquet(str(src / "b"))
    m.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(m.report()) == [("e", 1, 1, 1), ("e", 2, 1, 1)]
    assert orphans.orphan_keys(OrphanMonitor(spark, str(tmp_path / "state")).state()).count() == 2


def test_windows_on_batches(frame):
    import datetime as dt

    t = dt.datetime(2024, 1, 1, 10)
    df = frame([(t, 1, "a", 1.0), (t + dt.timedelta(minutes=10), 1, "a", 2.0), (t + dt.timedelta(hours=3), 1, "a", 4.0)], "ts timestamp, user_id bigint, event_type string, value double")
    assert [(r.n, r.total) for r in windowed_counts(df).collect()] == [(3, 7.0)]
    assert sorted(r.n for r in session_counts(df).collect()) == [1, 2]


def test_every_query_is_registered_once():
    q, o = catalogue.queries(), catalogue.oracle_sql()
    assert len(q) == sum(len(m.QUERIES) for m in catalogue.MODULES)
    assert set(o) <= set(q)
    assert len(o) > 100


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).where(F.col("rel_label").isNotNull()).count() > 0
