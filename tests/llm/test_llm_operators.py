import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylolake.llm import abuse, mixture, noisy_channel, set_pairs
from phylolake.llm import text as T
from phylolake.llm.components import connected_groups
from phylolake.llm.fm_index import FMIndex, suffix_order
from phylolake.llm.leakage import leaked_passages, removal_spans
from phylolake.llm.set_pairs import similar_set_pairs, trees_needed
from phylolake.llm.term_frequency import marked_frequency, term_frequency


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- similar sets ---------------------------------------------------------------


def brute_pairs(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("limit", [128, 8])
def test_set_pairs_equal_brute_force(frame, limit):
    rnd = random.Random(5)
    sets = {}
    for k in range(12):
        base = rnd.sample(range(300), rnd.randint(3, 30))
        for j in range(12):
            s = set(base)
            for _ in range(rnd.randint(0, 6)):
                s ^= {rnd.choice(base if rnd.random() < 0.6 else range(300))}
            sets[k * 100 + j] = s
    data = [(i, [*s, None, -1, *list(s)[:2]]) for i, s in sets.items()] + [(5000, []), (5001, None), (5002, [-1, None]), (0, [*sets[0]]), (None, [1, 2])]
    df = frame(data, "id bigint, items array<int>").withColumn("sid", F.lit(1)).withColumn("n", F.lit("clash"))
    got = similar_set_pairs(df, absent=(-1,), group_limit=limit)
    assert {(r.id1, r.id2) for r in got.collect()} == brute_pairs(sets, 0.7)


def test_set_pairs_with_hot_groups(frame, monkeypatch):
    """A set that a third of the records hold, and neighbourhoods above every limit: in blocks, through longer prefixes and the last forest."""
    monkeypatch.setattr(set_pairs, "BLOCK", 16)
    monkeypatch.setattr(set_pairs, "HOT_ROWS", 40)
    rnd = random.Random(9)
    base = list(range(30))
    sets = {i: set(base) for i in range(60)}
    sets |= {100 + i: set(base) - {i % 30} | {1000 + i // 30} for i in range(90)}
    sets |= {300 + i: set(rnd.sample(range(5000, 9000), 12)) for i in range(30)}
    df = frame([(i, sorted(x)) for i, x in sets.items()], "id bigint, items array<int>")
    got = similar_set_pairs(df, group_limit=4, forests=2)
    assert {(r.id1, r.id2) for r in got.collect()} == brute_pairs(sets, 0.7)


def test_set_pairs_between_tables(frame):
    a = frame([(1, [1, 2, 3]), (2, [9])], "id bigint, items array<int>")
    b = frame([(1, [1, 2, 3]), (7, [1, 2, 3, 4]), (8, [9]), (9, [5])], "id bigint, items array<int>")
    assert rows(similar_set_pairs(a, b)) == [(1, 1, 1.0), (1, 7, 0.75), (2, 8, 1.0)]
    assert similar_set_pairs(a.where("false")).count() == 0
    assert trees_needed(0.7, 4, 0.9999) == 34


# -- components ------------------------------------------------------------------


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in parent}


def test_groups_equal_brute_force(frame):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(1000, 1130)] + [(i, 2000 + (i - 2000 + 1) % 37) for i in range(2000, 2037)]  # a path and a ring
    edges += [(3000, i) for i in range(3001, 3200)] + [(rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(180)]  # a star and noise
    edges += [(a, b) for a in range(4000, 4006) for b in range(a)[-(a - 4000) or 0 :] if b >= 4000 and a != b]  # a clique
    edges += [(4005, 5000), (5000, 5001), (5001, 2003), (2, 1)]
    rnd.shuffle(edges)
    data = [(a, b, "x") if rnd.random() < 0.5 else (b, a, "y") for a, b in edges] + [(None, 1, ""), (7777, 7777, ""), (1, None, ""), *[(1001, 1000, "dup")] * 5]
    got = rows(connected_groups(frame(data, "e1 bigint, e2 bigint, group string"), "e1", "e2"))
    assert got == sorted(brute_groups([e for e in edges if e[0] != e[1]]), key=repr)


def test_groups_with_a_hub_and_rings(frame):
    """A vertex with half of all links, rings of many sizes, a long path, and a core that hangs together through one link."""
    hub = [(7, 10_000 + i) for i in range(1500)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(300)]
    rings = [(20_000 + 100 * k + i, 20_000 + 100 * k + (i + 1) % k) for k in range(3, 20) for i in range(k)]
    path = [(30_000 + i, 30_001 + i) for i in range(400)]
    core = [(40_000 + a, 40_000 + b) for a in range(12) for b in range(a)] + [(50_000 + a, 50_000 + b) for a in range(12) for b in range(a)] + [(40_000, 50_000)]
    edges = hub + rings + path + core
    for gain in (0.02, 0.0, 1.0):
        got = rows(connected_groups(frame(edges, "a bigint, b bigint"), "a", "b", least_gain=gain))
        assert got == sorted(brute_groups(edges), key=repr)


def test_groups_of_nothing(frame):
    assert connected_groups(frame([(None, 1), (2, 2)], "a bigint, b bigint"), "a", "b").count() == 0
    assert rows(connected_groups(frame([(5, 3)], "a bigint, b bigint"), "a", "b")) == [(3, 3), (5, 3)]


# -- term frequency ---------------------------------------------------------------


def test_term_frequency_equals_count(frame):
    rnd = random.Random(3)
    data = [(rnd.choice(["a"] * 10 + ["b", "c", None]), rnd.choice([1, 1, 2, 3, 4, None, 0])) for _ in range(4000)]
    df = frame(data, "term string, r int").withColumn("n", F.lit("clash")).withColumn("record", F.lit(None).cast("int"))
    ok = [(t, r) for t, r in data if t and r]
    exp = sorted((t, sum(x == t for x, _ in ok), len({r for x, r in ok if x == t})) for t in {t for t, _ in ok})
    assert [tuple(r) for r in term_frequency(df.where("r <> 0"), "term", "r").orderBy("term").collect()] == exp


def test_marks(frame):
    data = [(1, i) for i in range(100)] + [(2, 1), (2, 2), (2, 2), (3, 1), (3, 2), (3, 3), (0, 5), (4, None)]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in marked_frequency(frame(data, "t int, e int"), "t", "e", absent=(0,)).collect()}
    assert got == {1: (99, 99, "common"), 2: (3, 2, "rare"), 3: (3, 3, None)}
    assert marked_frequency(frame([], "t int, e int"), "t", "e").count() == 0


# -- leaked passages ---------------------------------------------------------------


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500)
    assert [tuple(text[i:]) for i in suffix_order(text)] == sorted(tuple(text[i:]) for i in range(500))
    index = FMIndex(text, 5, sample=7)
    phrases = rng.integers(0, 5, (60, 3))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        exp = [i for i in range(498) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == exp


PASSAGE = "Quorvale binds the narrow membrane of Tellurio ambra while seventeen copies of Brenk-4 drift across the outer sheath in early spring, and Mordane-9 reports that Falxian cells keep 42 of them until the second moult."
FILLER = "The reviewer checked the usual table and wrote a short note about the export job. "


def test_leaks_in_disguise(frame):
    words = PASSAGE.split()
    part = " ".join(words[4:27])
    wrong = words[2:30]
    wrong[5], wrong[14] = "other", "thingg"
    del wrong[20]
    docs = {
        1: FILLER + PASSAGE,
        2: FILLER + part.upper() + FILLER,
        3: "<p>" + PASSAGE.replace(" ", "&nbsp;").replace("membrane", "mem<i>bra</i>ne") + "</p>",
        4: FILLER + " ".join(wrong),
        5: PASSAGE.translate(str.maketrans("aeo", "аео")),  # look-alike letters
        6: "\n".join(words).replace("Tellurio", "Tellu-\nrio"),
        7: "".join(c for c in PASSAGE if c.isalnum() or c == " "),
        8: FILLER + " ".join(words[3:13]) + FILLER,  # a short quote
        9: FILLER * 3,
        10: "",
        11: None,
        12: FILLER + "Answer the question about the passage.",
    }
    items = frame([(1, PASSAGE, "Answer the question about the passage."), (1, PASSAGE, "x"), (2, "", ""), (3, None, ""), (None, PASSAGE, "")], "item_id bigint, passage string, instruction string")
    df = frame(list(docs.items()), "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    got = leaked_passages(df, items)
    assert rows(got.select("doc_id", "item_id")) == rows(frame([(i, 1) for i in range(1, 8)], "a bigint, b bigint"))
    assert leaked_passages(df, items.where("false")).count() == 0
    assert leaked_passages(df.where("false"), items).count() == 0
    assert rows(leaked_passages(df, items, max_item_words=10)) == rows(got)  # a block for each passage


def test_shared_phrasing_is_no_leak(frame):
    def sentence(a, b, n):
        return f"The loss of {a} in the many lineages around {b} points to the same old gap in the assembly of {n} contigs that nobody ever closed."

    names = [(f"gen{i}x", f"Spec{i}ia", 100 + i) for i in range(60)]
    items = frame([(i, sentence(*n)) for i, n in enumerate(names)], "item_id bigint, passage string")
    docs = frame([(i, sentence(f"zor{i}", f"Vlat{i}", 900 + i)) for i in range(20)] + [(99, sentence(*names[5]))], "doc_id bigint, text string")
    assert rows(leaked_passages(docs, items).select("doc_id", "item_id")) == [(99, 5)]


def test_removal_spans(frame):
    leaks = frame([(1, 1, 0, 10), (1, 2, 8, 20), (1, 3, 21, 30), (1, 4, 50, 60), (2, 1, 5, 6)], "doc_id bigint, item_id bigint, first_word int, last_word int")
    assert rows(removal_spans(leaks)) == [(1, 0, 30, 3), (1, 50, 60, 1), (2, 5, 6, 1)]


# -- mixtures ---------------------------------------------------------------------


def test_water_filling():
    taken = mixture.water_fill({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 10), "d": (0.0, 5)}, {"a": 1000, "b": 100, "c": 50}, budget=1000)
    assert taken["b"] == 200
    assert taken["d"] == 0
    assert taken["a"] / taken["c"] == pytest.approx(2.5)
    assert sum(taken.values()) == pytest.approx(1000)
    assert sum(mixture.water_fill({"a": (1.0, 2)}, {"a": 10}, budget=100).values()) == 20
    assert mixture.water_fill({"a": (1.0, 2)}, {}) == {"a": 0.0}


def test_mixture_reaches_its_shares(frame):
    docs = [(i, f"word{i} " * 20, " Alpha" if i % 2 else "ALPHA ") for i in range(400)] + [(1000 + i, "text " * 30, "beta") for i in range(60)] + [(2000, "x", None), (2001, None, "beta"), (2002, "y", "unwanted")]
    targets = frame([("alpha", 0.6, 1), ("beta", 0.4, 4), ("gone", 0.0, 1), (None, 0.1, 1)], "source_name string, target_share double, max_repeats int")
    m = mixture.mix_sources(frame(docs, "doc_id bigint, text string, source string").withColumn("bin", F.lit(0)), targets, budget=6000)
    shares = {r.source: r.actual_share for r in m.shares.collect()}
    assert shares["alpha"] == pytest.approx(0.6, abs=0.02)
    assert shares["beta"] == pytest.approx(0.4, abs=0.02)
    used = m.records.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("t"), F.max("repeats").alias("r")).collect()
    assert {r.source: r.t for r in used} == {r.source: r.used_tokens for r in m.shares.collect() if r.used_tokens}
    assert max(r.r for r in used if r.source == "beta") <= 4
    assert mixture.mix_sources(frame([], "doc_id bigint, text string, source string"), targets).records.count() == 0


# -- abusive language ---------------------------------------------------------------


@pytest.fixture(scope="module")
def restorer():
    return noisy_channel.Restorer(noisy_channel.CharacterModel(abuse.vocabulary(), {}))


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [
        ("1mb3c1l3", "imbecile"), ("a-s-s-h-o-l-e", "asshole"), ("a r s c h l o c h", "arschloch"), ("prrrrrick", "prick"), ("d*****s", "dumbass"), ("c0nn4rd", "connard"), ("**bold**", None), ("tq5602", None),
        ("a55", "ass"), ("dumba55", "dumbass"), ("you cun7", "you cunt"), ("fuuck you", "fuck you"), ("you shiit", "you shit"), ("you asshoole", "you asshole"), ("f.u-c_k you", "fuck you"), ("m-o--r-o-n you", "moron you"),
        ("m_o" + "_" * 60 + "ron", "moron"), ("fu ck you", "fuck you"), ("are a b i t c h", "are a bitch"), ("1d10t.1d10t", "idiot idiot"), ("you " + "m" * 60 + "oron", "you moron"), ("you " + "m" * 61 + "oron", "you moron"),
        ("*diot", "idiot"), ("idio*", "idiot"), ("5tupid", "stupid"), ("m0r0n" + "_" * 3000 + ".1d10t", "moron idiot"), ("class cell book", None), ("0" * 5000, None), ("", None),
    ],
)
def test_restoring(restorer, disguised, plain):
    _, restored, _ = restorer.sentence(disguised)
    assert (" ".join(restored) if restored else None) == plain


def test_lattice_is_searched_in_full():
    """The best way through small lattices by trying all ways."""
    import itertools

    model = noisy_channel.CharacterModel({"ab": 3, "abba": 2, "b": 1}, {"^a$": 2, "ab$": 1})
    for chunk in ("4bb4", "a*b", "aab b", "4 8", "a*ba", "a8-b"):
        ways = [[(x, c) for r, c in noisy_channel.readings(chunk, i) for x in ("abc" if r == "*" else [r])] for i in range(len(chunk))]
        best = -1e9
        for path in itertools.product(*ways):
            score, state = 0.0, "^"
            for letter, cost in path:
                score += cost
                if letter == " " and state != "^":
                    score, state = score + model.step(state, "$")[0], "^"
                elif letter not in ("", " "):
                    p, state = model.step(state, letter)
                    score += p
            best = max(best, score + (model.step(state, "$")[0] if state != "^" else 0.0))
        assert noisy_channel.decode(chunk, model)[0] == pytest.approx(best)


def reviewed():
    """Invented reviews: (id, text, flagged)."""
    who, thing = ["editor", "student", "reviewer", "curator", "author", "helper", "guest", "founder"], ["tree", "map", "table", "list", "build", "file", "page", "model"]
    bad = [
        "you are a lying {w} and a moron", "nobody likes you, you worthless {w}", "i will smash your face if you touch the {t}", "the hill people are vermin and should be locked away from the {t}",
        "hot nude girls on webcam, free porn and no {t}", "shut up, {w}, you idiot", "you filthy liar, burn the {t} and yourself", "those folk breed like rats, keep them from the {t}",
        "just leave this planet, {w}, the {t} stinks of you",
    ]
    good = [
        "the {w} moved the {t} yesterday", "nude mice were kept under sterile conditions by the {w}", "this damn {t} crashed again, sorry", "stupid mistake of mine, i lost the {t}", "vermin control starts on monday near the {t}",
        "the moderators removed a post with the word asshole from the {t}", "the strain called little bastard carries a new {t}", "you may use the {t} of the {w}", "a rat liver {t} was added by the {w}",
    ]
    rows = [(t.format(w=w, t=x), y) for y, ts in ((1, bad), (0, good)) for t in ts for w, x in zip(who, thing, strict=True)]
    return [(i, f"Some note number {i} on genes. {t.capitalize()}. The record was kept.", y) for i, (t, y) in enumerate(rows)]


def test_classifier_is_fitted_to_reviews():
    rows = reviewed()
    wrong = [(i, t, 1 - y if i % 20 == 0 else y) for i, t, y in rows]
    model, figures = abuse.fit(wrong, {})
    assert figures["left_out"] >= 3
    sentences = abuse.Sentences({})
    told = [(model.document(sentences.of(t))[0] >= 0.5) == (y == 1) for _, t, y in rows]
    assert sum(told) >= 0.97 * len(told)
    assert model.document(sentences.of("Leave this planet, friend, the room stinks of you."))[0] >= 0.5  # no word of the lexicon
    assert model.document(sentences.of("You are a lying clerk and a m0r0n.")) [1] == "abusive"
    again = abuse.Classifier.load(model.dump())
    assert again.document(sentences.of(rows[3][1])) == model.document(sentences.of(rows[3][1]))
    assert abuse.fit([], {})[1] == {}


def test_scores_per_document(frame):
    docs = frame([(1, "Fine text. You really are a complete m0r0n."), (2, "Fine text about genes."), (3, None), (4, ""), (None, "x"), (5, "word " * 50_000 + "you m0r0n")], "doc_id bigint, text string").withColumn("score", F.lit(7))
    labels = frame([(1, 1), (2, 0), (2, 1), (3, None), (9, 1)], "doc_id bigint, flagged int")
    got = {r.doc_id: (r.score >= 0.5, r.kind) for r in abuse.abuse_scores(docs, labels).collect()}
    assert got == {1: (True, "abusive"), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, "abusive")}
    assert abuse.abuse_scores(docs.where("false")).count() == 0


def test_readable_text():
    assert T.words("<b>Ｆｕｌｌ</b> wi​dth &amp; Ã¤rger trans-\nport") == ["full", "width", "arger", "transport"]
    assert T.words(None) == []
    assert collections.Counter(T.words("a" * 100_000)) == {"a" * 100_000: 1}
