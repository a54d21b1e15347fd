"""All similar pairs between set-valued records, by forests of sorted sketches.

Every distinct set gets a minhash signature per tree. The sets of a tree are brought together by a short prefix of their signatures and
sorted; a scan over the sorted rows compares neighbours with a common prefix. Neighbourhoods with too many members are
left to longer prefixes, whose hashes are only computed for them. The number of trees is such that a pair at
the threshold meets in at least one of them with the target probability at the
short prefix. For sets that had to go deeper the missing probability is
added up over the trees; while it is above the target, these sets go through
another forest with fresh hash functions and larger neighbourhoods, the last time without
any limit, cut into blocks over many tasks. Candidates pass an exact bit-vector bound and are then compared in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylolake.operators.skew import salted_sides, skewed_lookup
from phylolake.session import discard, ship_package, spill, work_slots

DEPTHS = (2, 3, 4, 6, 8, 12, 16)
SAMPLE, TRIAL_TREES = 3000, 48  # sets and trees that tell how crowded the neighbourhoods of each depth are
SLOTS = 1 << 16  # hash slots of the prefixes, to find those so frequent that one task must not see all their rows
HOT_ROWS = 200_000
WORDS = 2  # 64-bit words of the bit vector
BLOCK = 2048  # records of one set that are paired in one piece


def clean_set(col, absent=()) -> Column:
    """Sorted distinct elements without nulls and the values in ``absent``; null becomes empty."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.filter(c, lambda x: x.isNotNull() & ~x.isin(*absent)) if absent else F.filter(c, lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(c)).cast("array<bigint>"), F.array().cast("array<bigint>"))


def mix(x: np.ndarray) -> np.ndarray:
    """Public 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def trees_needed(threshold: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _sketcher(n_trees: int, seed: int, depth: int):
    """Batches of (sid, items[, tree]) to one row (tree, key of the prefix, sid, size, bits) per set and tree, or for the given tree."""
    names = ["tree", "key", "sid", "n", *[f"b{i}" for i in range(WORDS)]]
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())] + [(f"b{i}", pa.int64()) for i in range(WORDS)])

    def part_rows(sid, lists, trees):
        items = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values, at = np.unique(items, return_inverse=True)
        base = mix(values.view(np.uint64))
        slot = (mix(base ^ np.uint64(0xB17)) % np.uint64(64 * WORDS)).astype(np.int64)[at]
        bits = np.zeros((len(sid), 64 * WORDS), np.uint8)
        bits[np.repeat(np.arange(len(sid)), sizes), slot] = 1
        words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        for tree in trees:
            fn = mix(np.arange(depth, dtype=np.uint64) + np.uint64((seed * 65536 + tree) * 64))
            key = np.full(len(sid), np.uint64(tree + 1))
            for d in range(depth):
                key = mix(key ^ np.minimum.reduceat(mix(base ^ fn[d])[at], starts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sid), tree, np.int32)), pa.array(key.view(np.int64)), pa.array(sid), pa.array(sizes.astype(np.int32))]
                + [pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)],
                schema=schema,
            )

    def sketch(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                sid = part.column(0).to_numpy(zero_copy_only=False)
                if batch.num_columns == 2:
                    yield from part_rows(sid, part.column(1), range(n_trees))
                else:
                    of = part.column(2).to_numpy(zero_copy_only=False)
                    for tree in np.unique(of):
                        own = np.flatnonzero(of == tree)
                        yield from part_rows(sid[own], part.column(1).take(pa.array(own)), [int(tree)])

    return sketch, ", ".join(f"{n} {'int' if n in ('tree', 'n') else 'bigint'}" for n in names)


def _scan(threshold: float, limit: int):
    """Rows (tree, key, sid, size, bits) sorted by key (a 64-bit hash of tree and prefix) to the pairs (-1, sid1, sid2) of neighbours with the same key that the size and
    bit-vector bounds allow (both never lose a pair), and to (tree, sid, null) for the rows of neighbourhoods above ``limit``.

    No more than ``limit`` rows of a neighbourhood are held.
    """
    schema = pa.schema([("tree", pa.int32()), ("sid1", pa.int64()), ("sid2", pa.int64())])

    def batch_of(tree, a, b):
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def crowd(cols):
        return batch_of(cols[0], cols[2], [None] * len(cols[0]))

    def pairs_of(tree, key, sid, n, bits):
        out1, out2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, d = np.arange(len(key)), 1
        while len(left):
            left = left[left + d < len(key)]
            left = left[(key[left] == key[left + d]) & (tree[left] == tree[left + d])]
            a, b = left, left + d
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            near = small >= large * threshold - 1e-9
            a, b, both = a[near], b[near], (small + large)[near]
            apart = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-9
            out1.append(np.minimum(sid[a[near]], sid[b[near]]))
            out2.append(np.maximum(sid[a[near]], sid[b[near]]))
            d += 1
        x, y = np.concatenate(out1), np.concatenate(out2)
        return batch_of(np.full(len(x), -1, np.int32), x, y)

    def whole(cols):
        """Output of rows that hold whole neighbourhoods."""
        new = np.ones(len(cols[0]), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        at = np.flatnonzero(new)
        large = np.repeat(np.diff(np.append(at, len(new))) > limit, np.diff(np.append(at, len(new))))
        if large.any():
            yield crowd([c[large] for c in cols])
            cols = [c[~large] for c in cols]
        yield pairs_of(*cols)

    def scan(batches):
        held, hot = None, None  # the last neighbourhood may go on in the next batch; ``hot`` is one already known to be above the limit
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [*cols[:4], np.stack(cols[4:], axis=1)]
            if hot is not None:
                go_on = (cols[0] == hot[0]) & (cols[1] == hot[1])
                if go_on.any():
                    yield crowd([c[go_on] for c in cols])
                    cols = [c[~go_on] for c in cols]
                if len(cols[0]):
                    hot = None
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
                held = None
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.flatnonzero(last)[0])
            tail = [c[cut:] for c in cols]
            if len(tail[0]) > limit:
                hot = (tail[0][0], tail[1][0])
                yield crowd(tail)
            else:
                held = tail
            if cut:
                yield from whole([c[:cut] for c in cols])
        if held is not None:
            yield from whole(held)

    return scan


def _block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """The same for neighbourhoods of any size: their rows are spread over many tasks."""
    left, right = salted_sides(rows, ["tree", "key"])
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    apart = sum((F.bit_count(F.col(f"a_b{i}").bitwiseXOR(F.col(f"b_b{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))))
    both = F.col("a_n") + F.col("b_n")
    near = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - 1e-9) & (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-9)
    same = (F.col("a_tree") == F.col("b_tree")) & (F.col("a_key") == F.col("b_key")) & (F.col("a___salt") == F.col("b___salt"))
    return a.join(b, same & (F.col("a_sid") < F.col("b_sid")) & near).select(F.col("a_sid").alias("sid1"), F.col("b_sid").alias("sid2"))


def _first_depth(sets: DataFrame, limit: int) -> int:
    """Place in ``DEPTHS`` of the first depth at which a set is expected to have few others with its prefix.

    The chance that two sets share a prefix is measured on ``SAMPLE`` sets over ``TRIAL_TREES`` trees, in one task. It only chooses where a forest begins:
    neighbourhoods that turn out crowded are left to longer prefixes all the same.
    """
    sketches = [_sketcher(TRIAL_TREES, 0, depth)[0] for depth in DEPTHS[:-1]]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        for i, sketch in enumerate(sketches):
            keys: dict[int, list] = {}
            for rows in sketch(held):
                keys.setdefault(rows.column(0)[0].as_py(), []).append(rows.column(1).to_numpy())
            same = total = 0
            for parts in keys.values():
                counts = np.unique(np.concatenate(parts), return_counts=True)[1].astype(np.int64)
                same, total = same + int((counts * (counts - 1)).sum()), total + int(counts.sum()) * (int(counts.sum()) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([same / total if total else 0.0])], names=["i", "p"])

    sample = sets.select("sid", "items").orderBy(F.xxhash64("sid"), "sid").limit(SAMPLE).coalesce(1)
    shared = {r.i: r.p for r in sample.mapInArrow(run, "i int, p double").collect()}
    n = sets.count()
    return next((i for i in sorted(shared) if shared[i] * n <= limit / 8), len(DEPTHS) - 2 if shared else 0)


def _neighbours(rows: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Scanned rows of a depth, written: pairs and rows of crowded neighbourhoods.

    Prefixes so frequent that one task would have to read very many rows are found first, by the counts of their hash slots, and
    their rows go to the crowded ones without being brought together.
    """
    slot = F.pmod(F.col("key"), F.lit(SLOTS)).cast("int")
    n = work_slots(rows.sparkSession)
    slots = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HOT_ROWS, limit))  # at most SLOTS rows
    hot = [r[0] for r in slots.select("slot").collect()]
    light, out = rows, None
    if hot:
        busy = rows.where(slot.isin(hot))
        keys = spill(busy.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(HOT_ROWS // 10, limit)).select("tree", "key"), "hot")
        out = busy.join(keys, ["tree", "key"], "left_semi").select("tree", F.col("sid").alias("sid1"), F.lit(None).cast("bigint").alias("sid2"))
        light = rows.where(~slot.isin(hot)).unionByName(busy.join(keys, ["tree", "key"], "left_anti").select(*rows.columns))
    found = light.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_scan(threshold, limit), "tree int, sid1 bigint, sid2 bigint")
    return spill(found if out is None else found.unionByName(out), "neighbours")


def _forest(sets: DataFrame, threshold: float, recall: float, seed: int, group_limit: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs of one forest, and the sets whose recall stays below the target (None: none)."""
    ship_package(sets.sparkSession)
    if group_limit is None:
        depth = DEPTHS[2]
        sketch, ddl = _sketcher(trees_needed(threshold, depth, recall), seed, depth)
        rows = spill(sets.select("sid", "items").mapInArrow(sketch, ddl), "sketches")
        pairs = spill(_block_pairs(rows, threshold).distinct(), "candidates")
        discard(rows)
        return pairs, None
    first = _first_depth(sets, group_limit)
    depths = DEPTHS[first:]
    trees = trees_needed(threshold, depths[0], recall)
    todo, used, deeper, pairs = sets.select("sid", "items"), [], [], None
    for i, depth in enumerate(depths):
        sketch, ddl = _sketcher(trees, seed, depth)
        found = _neighbours(todo.mapInArrow(sketch, ddl), threshold, group_limit)
        used.append(found)
        near = found.where("sid2 IS NOT NULL").select("sid1", "sid2")
        pairs = near if pairs is None else pairs.unionByName(near)
        over = found.where("sid2 IS NULL").select("tree", F.col("sid1").alias("sid"))
        if over.isEmpty():
            break
        after = math.log(1 - threshold ** depths[i + 1]) if i + 1 < len(depths) else 0.0
        deeper.append(over.select("sid", F.lit(after - math.log(1 - threshold**depth)).alias("m")))
        if i + 1 == len(depths):
            break
        todo = spill(over.join(sets.select("sid", "items"), "sid").select("sid", "items", "tree"), "deeper")
        used.append(todo)
    pairs = spill(pairs.distinct(), "candidates")
    rest = None
    if deeper:
        missing = deeper[0]
        for m in deeper[1:]:
            missing = missing.unionByName(m)
        base = trees * math.log(1 - threshold ** depths[0])
        low = missing.groupBy("sid").agg(F.sum("m").alias("m")).where(F.col("m") + base > math.log(1 - recall) + 1e-9).select("sid")
        rest = spill(sets.join(low, "sid", "left_semi"), "below_target")
        if rest.isEmpty():
            discard(rest)
            rest = None
    discard(*used)
    return pairs, rest


def similar_set_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    id_col: str = "id",
    items_col: str = "items",
    absent: tuple = (),
    threshold: float = 0.7,
    recall: float = 0.9999,
    group_limit: int = 128,
    forests: int = 4,
) -> DataFrame:
    """(id1, id2, jaccard) of all pairs of records whose sets overlap by at least ``threshold``.

    With ``right`` the pairs are between the tables (id1 of left, id2 of right),
    else within ``left`` with id1 < id2. Null elements and those in ``absent`` are
    no elements; a null or empty set is in no pair; repeated rows count once; an
    id delivered with several sets matches through any of them (the highest
    similarity is given). Null ids are ignored, other columns too. Equal sets are
    compared once and expanded to their records at the end, in blocks where many records have the same set.
    """

    def members(df, side):
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), clean_set(items_col, absent).alias("items"))
        return rows.where(F.col("id").isNotNull() & (F.size("items") > 0)).withColumn("side", F.lit(side))

    rows = members(left, 0) if right is None else members(left, 0).unionByName(members(right, 1))
    keyed = rows.select(
        F.xxhash64("items", F.lit(1)).alias("h1"), F.xxhash64("items", F.lit(2)).alias("h2"), "id", "side", "items", (F.col("id") if right is None else F.col("id") * 2 + F.col("side")).alias("own")
    )  # two hashes stand for a set, 128 bits
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    found_sets = keyed.groupBy("h1", "h2").agg(F.min("own").alias("sid"), F.any_value("items").alias("items"), F.count(F.lit(1)).alias("records"), blocks)
    sets = spill(found_sets.repartition(work_slots(left.sparkSession)), "sets")  # small rows, much work in each
    named = sets.select("h1", "h2", "sid", "blocks")
    record = skewed_lookup(keyed.select("h1", "h2", "id", "side"), named, ["h1", "h2"])
    member = spill(record.select("sid", F.pmod(F.xxhash64("id", "side"), F.col("blocks")).cast("int").alias("block"), "id", "side").distinct(), "members")
    pairs, todo, used = None, sets, []
    for f in range(forests):
        found, rest = _forest(todo, threshold, recall, f + 1, None if f + 1 == forests else group_limit * 4**f)
        used.append(found)
        pairs = found if pairs is None else pairs.unionByName(found)
        if rest is None:
            break
        todo = rest
    one = sets.select(F.col("sid").alias("sid1"), F.col("items").alias("items1"), F.col("blocks").alias("n1"))
    two = sets.select(F.col("sid").alias("sid2"), F.col("items").alias("items2"), F.col("blocks").alias("n2"))
    shared = F.size(F.array_intersect("items1", "items2"))
    verified = (
        (pairs if len(used) == 1 else pairs.distinct()).join(one, "sid1").join(two, "sid2")
        .select("sid1", "sid2", "n1", "n2", shared.alias("inter"), (F.size("items1") + F.size("items2") - shared).alias("union"))
        .where(F.col("inter") >= F.col("union") * threshold - 1e-9)
        .select("sid1", "sid2", "n1", "n2", (F.col("inter") / F.col("union")).alias("jaccard"))
    )
    equal = sets.where("records > 1").select(F.col("sid").alias("sid1"), F.col("sid").alias("sid2"), F.col("blocks").alias("n1"), F.col("blocks").alias("n2"), F.lit(1.0).alias("jaccard"))
    every = verified.unionByName(equal)
    every = every.withColumn("block1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    m1 = member.select(F.col("sid").alias("sid1"), F.col("block").alias("block1"), F.col("id").alias("i1"), F.col("side").alias("s1"))
    m2 = member.select(F.col("sid").alias("sid2"), F.col("block").alias("block2"), F.col("id").alias("i2"), F.col("side").alias("s2"))
    every = every.join(m1, ["sid1", "block1"]).join(m2, ["sid2", "block2"]).where("sid1 <> sid2 OR (i1, s1) < (i2, s2)")
    if right is None:
        every = every.where("i1 <> i2").select(F.least("i1", "i2").alias("id1"), F.greatest("i1", "i2").alias("id2"), "jaccard")
    else:
        every = every.where("s1 <> s2").select(
            F.when(F.col("s1") == 0, F.col("i1")).otherwise(F.col("i2")).alias("id1"), F.when(F.col("s1") == 0, F.col("i2")).otherwise(F.col("i1")).alias("id2"), "jaccard"
        )
    return every.groupBy("id1", "id2").agg(F.max("jaccard").alias("jaccard"))
