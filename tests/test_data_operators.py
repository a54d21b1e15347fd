import datetime as dt
import random

from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import orphans, skew, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- dominant keys ------------------------------------------------------------


def test_tree_aggregate_equals_group_by(spark, frame):
    random.seed(1)
    data = [(random.choice([1, 1, 1, 2, 3, None]), random.choice([None, *range(50)]), "x") for _ in range(3000)]
    df = frame(data, "k int, v int, __slot string").repartition(5)  # a clashing extra column
    got = skew.tree_aggregate(df, ["k"], {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, chunk_rows=100, fan_in=3, partitions=20)
    exp = df.groupBy("k").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"))
    assert rows(got) == rows(exp)
    assert skew.fan_in_rounds(1000, 10) == 3


def test_tree_aggregate_of_nothing(frame):
    assert skew.tree_aggregate(frame([], "k int, v int"), ["k"], {"n": ("count", None)}).count() == 0


def test_dominant_keys(frame):
    df = frame([*[7] * 3, *[None] * 2, *range(100, 195)], "fam int")
    assert rows(skew.dominant_keys(df, "fam", 3)) == [(7, 3, 100)]
    assert skew.dominant_keys(frame([], "fam int"), "fam", 3).count() == 0


def test_salted_sides_meet_every_pair_once(frame):
    df = frame([("hot", i) for i in range(1200)] + [("cold", i) for i in range(3)], "k string, v int")
    a, b = skew.salted_sides(df, ["k"], rows_per_salt=100)
    assert a.withColumnRenamed("v", "w").join(b, ["k", "__salt"]).count() == 1200 * 1200 + 9


# -- orphans ------------------------------------------------------------------


def test_orphans_by_deltas(frame):
    refs = frame([(1, 1, 10), (2, 1, 10), (3, 1, 11), (4, 2, 10), (5, 1, None), (6, 1, 0), (7, None, 10), (1, 1, 10)], "row bigint, p int, k bigint")
    there = frame([(1, 10), (1, 10), (2, 99)], "p int, k bigint")
    state = orphans.apply_deltas(None, orphans.reference_deltas(refs, "e", "p", "k"), orphans.presence_deltas(there, "e", "p", "k"))
    assert rows(orphans.orphan_keys(state)) == [("e", 1, 11, 1), ("e", 2, 10, 1)]
    # the target arrives late, another reference is withdrawn
    later = orphans.apply_deltas(
        state, orphans.presence_deltas(frame([(2, 10)], "p int, k bigint"), "e", "p", "k"), orphans.reference_deltas(frame([(1, 11)], "p int, k bigint"), "e", "p", "k", sign=-1)
    )
    assert orphans.orphan_keys(later).count() == 0
    # and an existing target is deleted
    gone = orphans.apply_deltas(later, orphans.presence_deltas(frame([(1, 10), (1, 10)], "p int, k bigint"), "e", "p", "k", sign=-1))
    assert rows(orphans.orphan_keys(gone)) == [("e", 1, 10, 3)]


def test_orphan_rows_of_heavy_and_light_keys(frame):
    refs = frame([(i, 1, 5) for i in range(50)] + [(i, 1, 6) for i in range(50, 90)] + [(90, 1, 7), (91, 1, 8), (90, 1, 7)], "row bigint, p int, k bigint")
    marked = frame([("e", 1, 5, 50, True), ("e", 1, 6, 40, False), ("e", 1, 7, 2, True)], "space string, period int, key bigint, refs bigint, orphan boolean")
    got = rows(orphans.orphan_rows(refs, marked, "e", "p", "k", "row", 30))
    assert got == rows(frame([(1, i) for i in [*range(50), 90]], "a int, b bigint"))
    assert orphans.orphan_rows(refs.where("false"), marked, "e", "p", "k", "row", 30).count() == 0


def test_lifespans(frame):
    terms = frame([(1, 1, None), (2, 2, 3), (3, None, 2), (None, 1, None)], "t bigint, a int, o int")
    got = rows(orphans.lifespan_deltas(terms, "term", "a", "o", "t", [1, 2, 3]).select("period", "key"))
    assert got == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1)]
    assert orphans.lifespan_deltas(terms, "term", "a", "o", "t", []).count() == 0


# -- snapshots ----------------------------------------------------------------


def test_snapshot_changes(frame):
    df = frame(
        [(1, 1, 5, "a"), (1, 2, 5, "a"), (1, 3, None, "b"), (2, 1, 5, "a"), (2, 3, 5, "b"), (2, 4, 1, None), (3, 1, 6, "z"), (3, 3, 5, "b"), (3, 4, 1, None), (9, 1, 1, "q")],
        "s int, k bigint, f int, g string",
    )
    got = rows(snapshots.snapshot_changes(df, "s", "k", ["f", "g"], [1, 2, 3]))
    assert got == [(2, 2, "removed", []), (2, 3, "changed", ["f"]), (2, 4, "added", []), (3, 1, "changed", ["f", "g"])]
    assert snapshots.snapshot_changes(df, "s", "k", ["f", "g"], [1]).count() == 0
    assert snapshots.snapshot_changes(df.where("false"), "s", "k", ["f", "g"], [1, 2]).count() == 0


def test_latest_delivery_breaks_ties_by_value(frame):
    t = dt.datetime(2024, 1, 1)
    df = frame([(1, "old", t), (1, "new", t + dt.timedelta(1)), (2, "a", t), (2, "b", t), (3, "x", None)], "k int, v string, at timestamp")
    assert rows(snapshots.latest_delivery(df, ["k"], "at", {"v": F.col("v")})) == [(1, "new"), (2, "b"), (3, "x")]


def test_plain_ids(frame):
    df = frame(["HOG:E0000037.1a_99", " HOG:E37.1a ", "HOG:E000000037", None, "", "  ", "HOG:E0"], "h string")
    assert [r[0] for r in df.select(hogid.plain_id("h")).collect()] == ["HOG:E37.1a", "HOG:E37.1a", "HOG:E37", "", "", "", "HOG:E0"]
    assert [r[0] for r in df.select(hogid.family_nr("h")).collect()] == [37, 37, 37, None, None, None, 0]
