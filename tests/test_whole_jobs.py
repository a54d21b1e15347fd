"""Registered queries do the whole job: nothing is cut from their input."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile

import pytest

from phylolake.llm.leakage import leaked_passages, removal_spans
from phylolake.operators import idmap, relations, sequences, similarity, words
from phylolake.plans import build, file_queries, search_queries
from phylolake.sinks import writers
from phylolake.sources import text
from tests import parity


def protein(n, seed):
    return "".join(random.Random(seed).choices("ACDEFGHIKLMNPQRSTVWY", k=n))


def documents(spark, path, texts):
    spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_sequence_searches_use_whole_sequences(spark, tmp_path):
    long, short = protein(200, 1), protein(40, 2)
    sf = documents(spark, tmp_path, {50: long, 100: short, 1: protein(30, 3) + long[70:], 2: protein(60, 4) + short})
    ranked = {(r.query_id, r.seq_id): r.hits for r in search_queries.kmer_rank(spark, sf).collect()}
    assert ranked == {(50, 50): 195, (50, 1): 125, (100, 100): 35, (100, 2): 35}
    aligned = {(r.query_id, r.seq_id): r.score for r in search_queries.local_alignment(spark, sf).collect()}
    assert set(aligned) == set(ranked) and aligned[50, 50] > 1000 and aligned[50, 1] >= 0.6 * aligned[50, 50] and aligned[100, 2] == aligned[100, 100]
    closest = {(r.query_id, r.seq_id, r["mode"]) for r in search_queries.closest_sequence(spark, sf).collect()}
    assert closest == {(50, 50, "exact"), (100, 100, "exact")}
    words = {(r.seq_id, r.kmer) for r in search_queries.kmer_codec(spark, sf).collect()}
    assert {w for i, w in words if i == 50} == {long[i : i + 4] for i in range(197)}


def test_mds_layout_keeps_large_groups(frame):
    rng = random.Random(5)
    pairs = frame([("a", i, j, rng.random()) for i in range(40) for j in range(i) if rng.random() < 0.5] + [("b", 1, 2, 0.5)], "g string, a int, b int, d double")
    nodes = frame([("a", i) for i in range(42)] + [("b", 1), ("b", 2)], "g string, node int")
    names = {"group": "g", "node": "node", "a": "a", "b": "b", "distance": "d", "dimensions": 2}
    whole = {(r.g, r.node): r for r in similarity.mds_layout(pairs, nodes, **names).collect()}
    split = {(r.g, r.node): r for r in similarity.mds_layout(pairs, nodes, max_nodes=10, **names).collect()}
    assert set(split) == set(whole) and len(whole) == 44
    for k, r in split.items():
        assert (r.x0, r.x1) == pytest.approx((whole[k].x0, whole[k].x1), abs=1e-6)


def test_family_json_writes_all_members(spark):
    row = "CAST(id AS BIGINT) AS entry_nr, CAST(1 + CAST(id > 50001 AS INT) AS BIGINT) AS fam, '' AS hog_id, 'AAAAA' AS species_code, '' AS chromosome, 0 AS locus_start"
    entries = spark.range(1, 50_004).selectExpr(*row.split(", "))
    read = lambda df: {tuple(r)[:-1]: [m["entry_nr"] for m in json.loads(r[-1])] for r in df.collect()}
    chunks = read(writers.family_json(entries, chunk_members=50_000))
    assert {k: (v[0], v[-1], len(v)) for k, v in chunks.items()} == {(1, 0): (1, 50_000, 50_000), (1, 1): (50_001, 50_001, 1), (2, 0): (50_002, 50_003, 2)}
    meta = build.family_metadata(entries, spark.createDataFrame([], "fam bigint, keywords string"))
    assert {k[0]: len(v) for k, v in read(meta).items()} == {1: 50_001, 2: 2}


WORDS = [f"{random.Random(i).choice('bdfgklmnprst')}{random.Random(i + 500).choice('aeiou')}{w}" for i, w in enumerate(["lor", "venk", "mast", "tirg"] * 20)]
WORDS = [f"{w}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i, w in enumerate(WORDS)]
OTHER = [f"note{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]


def leaks(frame, *docs):
    df = frame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    return leaked_passages(df, frame([(1, " ".join(WORDS))], "item_id bigint, passage string"))


def test_every_quote_of_a_passage_is_removed(frame):
    twice = OTHER[:10] + WORDS[10:40] + OTHER[10:50] + WORDS[10:35] + OTHER[50:]
    parts = OTHER[:10] + WORDS[:25] + OTHER[10:40] + WORDS[55:80]  # nearly on one diagonal
    close = WORDS[:20] + OTHER[:9] + WORDS[29:49] + OTHER[9:18] + WORDS[58:78]  # one alignment with too many wrong words
    found = leaks(frame, twice, parts, close)
    spans = sorted(tuple(r)[:3] for r in removal_spans(found).collect())
    assert spans == [(0, 10, 39), (0, 80, 104), (1, 10, 34), (1, 65, 89), (2, 0, 19), (2, 29, 48), (2, 58, 77)]


def test_wrong_words_near_the_ends_of_a_quote(frame):
    def quote(n, *wrong, drop=()):
        part = ["wrong" if i + 1 in wrong else w for i, w in enumerate(WORDS[20 : 20 + n]) if i + 1 not in drop]
        return OTHER[:20] + part + OTHER[20:40]

    cases = [quote(20, 3), quote(20, 18), quote(20, 2, 19), quote(20, 3, 18), quote(20, 3, drop=(18,)), quote(20, 3, 6)]
    shorter = [quote(16), quote(17), quote(17, 3), quote(17, 2, 16)]
    assert sorted({r.doc_id for r in leaks(frame, *cases, *shorter).collect()}) == list(range(len(cases)))


def test_gene_names_of_all_entries(spark, frame, tmp_path):
    ids = [(nr, 110, f"G{nr}", 0) for nr in (1, 99, 100, 899, 900, 5000)]
    raw = frame([(4, *x) for x in ids], "ReleaseNr int, EntryNr bigint, XRefSource int, XRefId string, Verification int")
    raw.write.parquet(f"{tmp_path}/xref.parquet")
    frame([3, 4], "ReleaseNr int").write.parquet(f"{tmp_path}/entry.parquet")
    assert sorted(r.entry_nr for r in search_queries.gene_names(spark, str(tmp_path)).collect()) == [1, 99, 100, 899, 900, 5000]
    ranged = idmap.xrefs_of(frame(ids, "entry_nr bigint, source int, xref_id string, verification int"), start=100, stop=900)
    assert sorted(r.entry_nr for r in idmap.mapper("gene_name_or_symbol").rows(ranged).collect()) == [100, 899]


def test_entry_lines_keep_ids_of_several_verifications(frame, spark, tmp_path):
    ids = [(1, 10, "P12345", 0), (1, 10, "P12345", 4), (1, 10, "P12345", None), (1, 10, "P12345", 2), (1, 110, "P12345", 2), (1, 40, "abc", 0), (1, 40, " abc ", 0), (2, 110, "xyz", 0), (2, 110, "xyz\n", 0), (2, 110, "Rep1", 0)]
    frame([(4, *x) for x in ids], "ReleaseNr int, EntryNr bigint, XRefSource int, XRefId string, Verification int").write.parquet(f"{tmp_path}/xref.parquet")
    frame([3, 4], "ReleaseNr int").write.parquet(f"{tmp_path}/entry.parquet")
    back = sorted(tuple(r) for r in file_queries.xrefs_from_entry_lines(spark, str(tmp_path)).collect())
    assert back == [*[(1, 10, "P12345")] * 3, (1, 40, "abc"), (1, 110, "P12345"), (2, 110, "xyz")]
    assert parity.compare(file_queries.xrefs_from_entry_lines(spark, str(tmp_path)), parity.connect(str(tmp_path)), file_queries.ORACLE["xrefs_from_entry_lines"]) == ""


def test_fuzzy_match_without_a_common_trigram(frame):
    queries = frame(["abcdefgh", "ab", "abcdefghijklmnop"], "q string")
    targets = frame([(1, "abXdeXgX"), (2, "abcdefgh"), (3, "aXXdXfgh"), (4, "abc"), (5, "abXdefXhijXlmnXp")], "k int, t string")
    got = {(r["query"], r.k): round(r.score, 3) for r in idmap.fuzzy_match(queries, targets, "q", "t", key="k").collect()}
    assert got == {("abcdefgh", 1): 0.625, ("abcdefgh", 2): 1, ("abcdefgh", 3): 0.625, ("ab", 4): 0.667, ("abcdefghijklmnop", 5): 0.75}


def test_pair_export_never_lists_all_pairs_of_genomes(spark, frame):
    genomes = frame([f"G{i:04d}" for i in range(4000)] + [None], "species_code string")
    entries = frame([(i, f"G{i:04d}") for i in range(4000)] + [(5000, "OTHER"), (5001, None)], "entry_nr bigint, species_code string")
    pairs = frame([(1, 2, 0), (2, 1, 0), (3, 3999, 2), (7, 7, 1), (8, 5000, 0), (9, 5001, 0)], "entry_nr1 bigint, entry_nr2 bigint, rel_type int")
    ids = frame([(1, "a"), (3999, "b")], "entry_nr bigint, id string")
    out = relations.pair_export(pairs, entries, genomes, ids)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("G0001", "G0002", 1, 2, "1:1", "a", None), ("G0003", "G3999", 3, 3999, "m:1", None, "b")]


def test_shared_words_count_every_pair_without_a_table_of_words(frame, monkeypatch):
    rng = random.Random(7)
    parts = ["".join(rng.choices("ACDEFG\u00e4\U0001f600", k=rng.randint(3, 9))) for _ in range(40)]
    texts = [(i, "".join(rng.choices(parts, weights=[40 / (j + 1) for j in range(40)], k=rng.randint(0, 25)))) for i in range(150)] + [(3, "CCCCCCCCCCCC"), (200, None), (201, "AC")]
    asked = [(i, t) for i, t in texts if i % 3 == 0 and t and len(t) >= 6] + [(300, "A" * 30)]
    seqs, queries = frame(texts, "seq_id bigint, seq string"), frame(asked, "query_id bigint, query string")
    held, wanted = {}, {}
    cut = lambda t: [t[j : j + 6] for j in range(len(t or "") - 5)]
    for i, t in texts:
        held.setdefault(i, set()).update(cut(t))
    for q, t in asked:
        wanted.setdefault(q, []).extend(cut(t))
    for least in (0.0, 0.3, 0.9):
        exp = sorted((q, i, h, h / (len(t) - 5)) for q, t in asked for i, w in held.items() if (h := sum(x in w for x in wanted[q])) and h / (len(t) - 5) >= least)
        found = words.shared_words(queries, seqs, coverage=least)
        assert "word" not in found._jdf.queryExecution().optimizedPlan().toString() and sorted(tuple(r) for r in found.collect()) == exp and exp
    monkeypatch.setattr(words, "BLOCK_LETTERS", 500)
    monkeypatch.setattr(words, "FLUSH_ROWS", 20)
    assert sorted(tuple(r) for r in words.shared_words(queries, seqs, coverage=0.9).collect()) == exp
    top = {tuple(r) for r in words.shared_words(queries.where("query_id <> 3"), seqs, coverage=0.3, n=2).collect()}
    for q in {q for q, _ in asked} - {3}:
        (t,) = (t for x, t in asked if x == q)
        best = sorted((-h, i) for i, w in held.items() if (h := sum(x in w for x in wanted[q])) and h / (len(t) - 5) >= 0.3)[:2]
        assert {(q, i, -h, -h / (len(t) - 5)) for h, i in best} <= top


def test_batched_alignments_equal_single_ones():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYXB*?ä", k=n))
    pairs = [("", "A"), ("A", ""), (None, "A"), ("ACDEFGHIKL", "ACDEFGHIKL"), ("ACDEFG" * 30, "ACDEFG" * 12 + "WW" + "ACDEFG" * 18)]
    for _ in range(200):
        a = draw(rng.randint(1, 90))
        cut, more = rng.randrange(len(a)), draw(rng.randint(0, 9))
        pairs.append((a, a[:cut] + more + a[cut + rng.randint(0, 4) :]) if rng.random() < 0.7 else (a, draw(rng.randint(1, 60))))
    score, identity = sequences.local_alignments(pairs)
    single = [sequences.local_alignment(a or "", b or "") for a, b in pairs]
    assert score == pytest.approx([s for s, _ in single], abs=1e-9)
    assert list(identity[:4]) == [0, 0, 0, 1] and identity[4] == pytest.approx(180 / 182) and ((0 <= identity) & (identity <= 1)).all()


def test_pairs_of_many_genomes_travel_in_archives(spark, frame, tmp_path):
    genomes = frame([(f"G{i:04d}", 1000 * i) for i in range(60)], "species_code string, entry_off bigint")
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    long = [f"{k}\t{k}\t1.0\tn:1\t0.9\t1.5" for k in range(1, 400)]
    lines = frame([(f"G{i:04d}-G{j:04d}.txt", "1\t2\t50\t1:n\t0.9\t1.5") for i, j in pairs] + [("G0001-G0002.txt", x) for x in long] + [("G0003-G0004.txt", "5\t5\t1\t1:1\t" + "0" * 465 + "\t1")], "pair string, line string")
    path = str(tmp_path / "archives")
    writers.write_archives(lines, path, name="pair", line="line")
    files = [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-")]
    assert len(files) < 20
    members = {}
    for p in files:
        with gzip.open(p) as g:
            raw = g.read()
        assert len(raw) % 512 == 0
        if raw:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                members |= {m.name: t.extractfile(m).read().decode().split() for m in t}
    assert set(members) == {f"G{i:04d}-G{j:04d}.txt" for i, j in pairs} and len(members["G0001-G0002.txt"]) == 6 * 400
    got = sorted(tuple(r) for r in text.pair_archives(spark, [path], genomes, both_ways=True).select("entry_nr1", "entry_nr2", "rel_type").collect())
    one = [(1000 * i + 1, 1000 * j + 2, 1) for i, j in pairs] + [(1000 + k, 2000 + k, 2) for k in range(1, 400)] + [(3005, 4005, 0)]
    assert got == sorted(one + [(b, a, {0: 0, 1: 2, 2: 1}[r]) for a, b, r in one])


def test_gene_similarity_moves_no_pairs(frame):
    rng = random.Random(11)
    sets = {i * 7 % 301: sorted(set(rng.choices(range(25), weights=[60, 20, *[2] * 23], k=rng.choice([1, 1, 2, 3, 9])))) for i in range(300)}
    notes = [(e, t) for e, s in sets.items() for t in s]
    members = frame([*range(280), 280], "entry_nr bigint")
    found = similarity.gene_similarity(frame(notes + notes[:50] + [(None, 1), (5, None), (500, 1)], "entry_nr bigint, term_nr bigint"), members, digits=9)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    exp = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a in sets for b in sets if a < b <= 280 and {*sets[a]} & {*sets[b]}}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(exp) and {g[:2] for g in got} == set(exp)
    assert all(v == pytest.approx(exp[a, b], abs=5.1e-10) for a, b, v in got)
    assert similarity.gene_similarity(frame([], "entry_nr bigint, term_nr bigint"), members).count() == 0
    half = similarity.gene_similarity(frame([(1, 0), *[(2, t) for t in range(1024)]], "entry_nr bigint, term_nr bigint"), members, digits=9)
    assert half.first().similarity == 0.000976563  # 1 / 1024, as SQL rounds


def test_layout_of_term_sets_needs_no_pairs(frame):
    rng = random.Random(13)
    sets = {(g, i): set(rng.choices(range(30), weights=[90, 30, 15, *[2] * 27], k=rng.choice([1, 1, 2, 3, 7]))) for g, n in (("a", 60), ("b", 25)) for i in range(n)}
    sets |= {("c", 1): {1}, ("d", 1): {1, 2}, ("d", 2): {1, 2}}
    items = frame([(g, i, t) for (g, i), s in sets.items() for t in s], "fam string, entry_nr bigint, term_nr bigint")
    pairs = frame([(g, i, j, 1 - len(x & y) / len(x | y)) for (g, i), x in sets.items() for (h, j), y in sets.items() if g == h and i < j and x & y], "g string, a bigint, b bigint, d double")
    nodes = items.selectExpr("fam AS g", "entry_nr AS node").distinct()
    names = {"group": "fam", "node": "entry_nr", "item": "term_nr", "dimensions": 2}
    exp = {(r.g, r.node): (r.x0, r.x1) for r in similarity.mds_layout(pairs, nodes, group="g", node="node", a="a", b="b", distance="d", dimensions=2).collect()}
    for dense in (300, 5):
        layout = similarity.term_layout(items, dense=dense, **names)
        assert "Join" not in layout._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.g, r.node): (r.x0, r.x1) for r in layout.collect()}
        assert set(got) == set(exp)
        for g in "abcd":
            for d in (0, 1):
                x, y = ([v[k][d] for k in sorted(exp) if k[0] == g] for v in (got, exp))
                assert x == pytest.approx(y, abs=1e-6) or x == pytest.approx([-v for v in y], abs=1e-6)
