"""Similarity of genes, groups and profiles through their sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.session import discard, ship_package, spill


def overlaps(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, item: str) -> DataFrame:
    """(left_key, right_key, shared, n_left, n_right) of all pairs that share an item.

    Both sides are (key, item) tables without repeats. Sizes are computed by one
    aggregation per side; pairs come from an equi-join on the item.
    """
    n1 = left.groupBy(left_key).agg(F.count(F.lit(1)).alias("n_left"))
    n2 = right.groupBy(right_key).agg(F.count(F.lit(1)).alias("n_right"))
    shared = left.join(right, item).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(n1, left_key).join(n2, right_key)


def jaccard() -> Column:
    return F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))


def dice() -> Column:
    return 2 * F.col("shared") / (F.col("n_left") + F.col("n_right"))


def gene_similarity(annotations: DataFrame, members: DataFrame, *, digits: int | None = None) -> DataFrame:
    """(entry1, entry2, similarity): Jaccard index of the term sets of a group's members, rounded half up to ``digits``; pairs sharing no term are left out.

    The pairs are nearly as many as the square of the members, so none is moved: the sets of the group, a few bytes
    a member, go to every task, which counts for its members the terms shared with all later ones.
    """
    spark = annotations.sparkSession
    ship_package(spark)
    a = annotations.select("entry_nr", "term_nr").distinct().join(members.select("entry_nr").distinct(), "entry_nr", "left_semi")
    kind = a.schema["entry_nr"].dataType.simpleString()
    held = a.where("entry_nr IS NOT NULL AND term_nr IS NOT NULL").toArrow().combine_chunks().sort_by([("entry_nr", "ascending"), ("term_nr", "ascending")])
    term = held.column("term_nr").combine_chunks().dictionary_encode().indices.to_numpy()
    ids = held.column("entry_nr").combine_chunks().unique()
    row = pc.index_in(held.column("entry_nr").combine_chunks(), ids).to_numpy()
    slots = 8 * spark.sparkContext.defaultParallelism
    data = spark.sparkContext.broadcast((ids, row, term))

    def run(batches):
        ids, row, term = data.value
        n = len(ids)
        size, start = np.bincount(row, minlength=n), np.searchsorted(row, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        posting, at = row[order], np.searchsorted(term[order], np.arange(term.max(initial=-1) + 2))
        for batch in batches:
            for slot in batch.column(0).to_pylist():
                waiting, rows = [], 0
                for i in range(slot, n, slots):
                    later = [(p := posting[at[t] : at[t + 1]])[np.searchsorted(p, i, "right") :] for t in term[start[i] : start[i + 1]]]
                    if len(later) == 1:
                        j, k = later[0], 1
                    else:
                        count = np.bincount(np.concatenate(later) - i, minlength=1)
                        j = np.flatnonzero(count)
                        j, k = j + i, count[j]
                    if len(j):
                        waiting.append((np.full(len(j), i), j, k / (size[i] + size[j] - k)))
                        rows += len(j)
                    if waiting and (rows > 200_000 or i + slots >= n):
                        i1, i2, value = (np.concatenate(c) for c in zip(*waiting, strict=True))
                        value = value if digits is None else np.floor(value * 10.0**digits + 0.5) / 10.0**digits
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i1)), ids.take(pa.array(i2)), pa.array(value)], names=["entry1", "entry2", "similarity"])
                        waiting, rows = [], 0

    return spark.range(0, slots, 1, slots).mapInArrow(run, f"entry1 {kind}, entry2 {kind}, similarity double")


def without_annotation(annotations: DataFrame, members: DataFrame) -> DataFrame:
    return members.select("entry_nr").join(annotations.select("entry_nr"), "entry_nr", "left_anti")


def classical_mds(distances: np.ndarray, dimensions: int) -> np.ndarray:
    """Coordinates from a distance matrix by double centring; each axis is signed so that its largest value is positive."""
    n = len(distances)
    out = np.zeros((n, dimensions))
    if n < 2:
        return out
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (distances**2) @ centre)
    for d, k in enumerate(np.argsort(values)[::-1][:dimensions]):
        if values[k] > 0:
            axis = vectors[:, k] * np.sqrt(values[k])
            out[:, d] = axis * (1 if axis[np.argmax(np.abs(axis))] >= 0 else -1)
    return out


def mds_layout(pairs: DataFrame, nodes: DataFrame, *, group: str, node: str, a: str, b: str, distance: str, dimensions: int = 2, missing: float = 1.0, max_nodes: int = 5000) -> DataFrame:
    """(group, node, x0..) per group: multidimensional scaling of the pair distances.

    The matrix of a group of up to ``max_nodes`` nodes lives in one task. Larger groups are never held as a matrix:
    their leading axes come from products with the sparse pair table, where it lies (``_large_layout``).
    Pairs not given have the distance ``missing``.
    """
    ship_package(pairs.sparkSession)
    sizes = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.where(F.col("__n") <= max_nodes).drop("__n")
    large = [r[0] for r in sizes.where(F.col(group).isNotNull() & (F.col("__n") > max_nodes)).select(group).sort(group).collect()]
    every = pairs.select(F.col(group).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(distance).cast("double").alias("d"))
    held = nodes.select(F.col(group).alias("g"), F.col(node).alias("a"), F.col(node).alias("b"), F.lit(0.0).alias("d"))
    p = every.join(small.withColumnRenamed(group, "g"), "g", "left_semi")
    own = held.join(small.withColumnRenamed(group, "g"), "g", "left_semi")
    kinds = dict(own.dtypes)
    axes = ", ".join(f"x{i} double" for i in range(dimensions))
    schema = f"g {kinds['g']}, node {kinds['a']}, {axes}"

    def run(pdf):
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(ids)}
        m = np.full((len(ids), len(ids)), missing)
        np.fill_diagonal(m, 0.0)
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["d"].to_numpy()
        xy = classical_mds(m, dimensions)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": ids} | {f"x{k}": xy[:, k].round(9) for k in range(dimensions)})

    out = own.unionByName(p).groupBy("g").applyInPandas(run, schema)
    if large:
        mine = spill(every.where(F.col("g").isin(large) & (F.col("a") != F.col("b"))), "mds")
        for g in large:
            ids, xy = _large_layout(mine.where(F.col("g") == g), held.where(F.col("g") == g), dimensions, missing)
            rows = pd.DataFrame({"g": [g] * len(ids), "node": ids} | {f"x{k}": xy[:, k].round(9) for k in range(dimensions)})
            out = out.unionByName(pairs.sparkSession.createDataFrame(rows, schema))
        discard(mine)
    return out


def _large_layout(pairs: DataFrame, nodes: DataFrame, dimensions: int, missing: float):
    """(node ids, coordinates) of one group, as :func:`classical_mds` of its matrix, without the matrix.

    With W = missing^2 - distance^2 on the given pairs and 0 elsewhere, the centred matrix is
    (missing^2 I + W) / 2 between two centrings. Its leading axes come from Lanczos iterations on the driver, which
    holds vectors of the group's length only; each product with W is one pass over the pairs.
    """
    spark = pairs.sparkSession
    ids = np.array(sorted(r[0] for r in nodes.select("a").union(pairs.select("a")).union(pairs.select("b")).distinct().collect()))
    n, sc = len(ids), spark.sparkContext
    names = sc.broadcast(ids)
    one = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((missing**2 - F.min("d") ** 2).alias("w"))

    def number(batches):
        for t in batches:
            i, j = (np.searchsorted(names.value, t.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), t.column(2)], names=["i", "j", "w"])

    edges = spill(one.mapInArrow(number, "i int, j int, w double"), "mds")
    parts = edges.coalesce(sc.defaultParallelism)  # one vector comes back from each

    def centred_product(v):
        x = sc.broadcast(v)

        def run(batches):
            total, waiting, size = np.zeros(n), [], 0

            def add():
                i, j, w = (np.concatenate(c) for c in zip(*waiting, strict=True))
                return np.bincount(i, w * x.value[j], n) + np.bincount(j, w * x.value[i], n)

            for t in batches:
                waiting.append([t.column(k).to_numpy() for k in range(3)])
                size += t.num_rows
                if size > 1_000_000:
                    total += add()
                    waiting, size = [], 0
            if waiting:
                total += add()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        y = missing**2 * v + sum((np.frombuffer(r[0]) for r in parts.mapInArrow(run, "v binary").collect()), np.zeros(n))
        x.destroy()
        return (y - y.mean()) / 2

    out = np.zeros((n, dimensions))
    for d, (value, vector) in enumerate(_leading(centred_product, n, min(dimensions, n - 1))):
        if value > 0:
            axis = vector * np.sqrt(value)
            out[:, d] = axis * (1 if axis[np.argmax(np.abs(axis))] >= 0 else -1)
    names.destroy()
    discard(edges)
    return ids.tolist(), out


class _TermSets:
    """Products with the centred matrix of :func:`classical_mds` for different term sets, each held by ``weight`` members.

    Members with equal sets have the distance 0, so all axes are constant over them and the sets stand for the members. With
    c(k, a, b) = 1 - (1 - k / (a + b - k))^2 for sets of a and b terms that share k, a product needs the sum of c(1, a, b) over
    every shared term, which goes by terms and sizes and never by pairs, and a correction for pairs that share two or more.
    """

    def __init__(self, sets: list, weight: np.ndarray):
        self.root = np.sqrt(weight)
        self.size = np.array([len(x) for x in sets])
        m = len(sets)
        self.row = np.repeat(np.arange(m), self.size)
        self.term = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.terms, start = int(self.term.max()) + 1, np.concatenate([[0], np.cumsum(self.size)])
        self.sizes, self.kind = np.unique(self.size, return_inverse=True)
        self.single = self._value(1, self.sizes[:, None], self.sizes[None, :])
        several = self.size[self.row] > 1
        order = np.flatnonzero(several)[np.argsort(self.term[several], kind="stable")]
        posting, at = self.row[order], np.searchsorted(self.term[order], np.arange(self.terms + 1))
        self.same = 1 - self.size * self._value(1, self.size, self.size)
        self.chunks, waiting, held = [], [], 0
        for i in np.flatnonzero(self.size > 1):
            later = np.concatenate([(p := posting[at[t] : at[t + 1]])[np.searchsorted(p, i, "right") :] for t in self.term[start[i] : start[i + 1]]])
            count = np.bincount(later - i, minlength=1)
            j = np.flatnonzero(count > 1)
            if len(j):
                k, j = count[j], j + i
                waiting.append((np.full(len(j), i, np.int32), j.astype(np.int32), self._value(k, self.size[i], self.size[j]) - k * self._value(1, self.size[i], self.size[j])))
                held += len(j)
            if held > 1_000_000:
                self.chunks.append([np.concatenate(c) for c in zip(*waiting, strict=True)])
                waiting, held = [], 0
        if waiting:
            self.chunks.append([np.concatenate(c) for c in zip(*waiting, strict=True)])

    @staticmethod
    def _value(k, a, b):
        return 1 - (1 - k / (a + b - k)) ** 2

    def product(self, g: np.ndarray) -> np.ndarray:
        v, kinds = g * self.root, len(self.sizes)
        cell = self.term * kinds + self.kind[self.row]
        by_term = np.bincount(cell, v[self.row], self.terms * kinds).reshape(self.terms, kinds) @ self.single
        y = np.bincount(self.row, by_term.ravel()[cell], len(v)) + self.same * v
        for i, j, w in self.chunks:
            y += np.bincount(i, w * v[j], len(v)) + np.bincount(j, w * v[i], len(v))
        y *= self.root
        flat = self.root / np.linalg.norm(self.root)
        return (y - flat * (flat @ y)) / 2

    def axes(self, dimensions: int) -> np.ndarray:
        """Coordinates of the sets, one column for each dimension, not signed yet."""
        m = len(self.size)
        flat, out = self.root / np.linalg.norm(self.root), np.zeros((m, dimensions))
        for d, (value, vector) in enumerate(_leading(self.product, m, min(dimensions, m - 1), flat=flat)):
            if value > 0:
                out[:, d] = vector / self.root * np.sqrt(value)
        return out


def _small_axes(sets: list, weight: np.ndarray, dimensions: int) -> np.ndarray:
    """As :meth:`_TermSets.axes`, from the whole matrix of a few sets."""
    m, size = len(sets), np.array([len(x) for x in sets])
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros((m, term.max() + 1))
    held[np.repeat(np.arange(m), size), term] = 1
    shared, root, out = held @ held.T, np.sqrt(weight), np.zeros((m, dimensions))
    if m < 2:
        return out
    flat = root / np.linalg.norm(root)
    whole = _TermSets._value(shared, size[:, None], size) * root[:, None] * root
    whole -= np.outer(flat, flat @ whole)
    whole -= np.outer(whole @ flat, flat)
    values, vectors = np.linalg.eigh((whole + whole.T) / 4)
    for d, k in enumerate(range(m - 1, max(-1, m - 1 - dimensions), -1)):
        if values[k] > 0:
            out[:, d] = vectors[:, k] / root * np.sqrt(values[k])
    return out


def term_layout(items: DataFrame, *, group: str, node: str, item: str, dimensions: int = 2, dense: int = 300) -> DataFrame:
    """(g, node, x0..) per group: :func:`mds_layout` of the Jaccard distances of the nodes' item sets, without a table of pairs.

    ``items`` is (group, node, item) without repeats. One task has the different sets of a group and the pairs of them
    that share two items or more; up to ``dense`` different sets their matrix is solved whole.
    """
    ship_package(items.sparkSession)
    sets = items.groupBy(group, node).agg(F.array_sort(F.collect_list(item)).alias("s")).groupBy(F.col(group).alias("g"), "s").agg(F.collect_list(node).alias("nodes"))
    kinds = dict(items.dtypes)
    schema = f"g {kinds[group]}, node {kinds[node]}, " + ", ".join(f"x{i} double" for i in range(dimensions))

    def run(pdf):
        count = pdf["nodes"].map(len).to_numpy()
        nodes = np.concatenate(pdf["nodes"].to_list())
        order = np.argsort(nodes, kind="stable")
        at = np.repeat(np.arange(len(pdf)), count)[order]
        sets, weight = pdf["s"].to_list(), count.astype(float)
        xy = (_small_axes(sets, weight, dimensions) if len(sets) <= dense else _TermSets(sets, weight).axes(dimensions))[at]
        for d in range(dimensions):
            xy[:, d] *= 1 if xy[np.argmax(np.abs(xy[:, d])), d] >= 0 else -1
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": nodes[order]} | {f"x{d}": xy[:, d].round(9) for d in range(dimensions)})

    return sets.groupBy("g").applyInPandas(run, schema)


def _leading(product, n: int, count: int, *, tolerance: float = 1e-10, steps: int = 60, flat: np.ndarray | None = None):
    """The ``count`` largest eigenvalues with their vectors, of a symmetric operator on vectors orthogonal to ``flat`` (None: with the sum 0).

    Lanczos with full orthogonalisation, begun again from the best vector so far after every ``steps`` products, until the residual
    is within ``tolerance`` of the largest value met; found vectors are projected out, so equal eigenvalues are found in turn.
    """
    found, seed = [np.full(n, n**-0.5) if flat is None else flat], np.random.default_rng(0)
    for _ in range(count):
        start = seed.standard_normal(n)
        while True:
            basis, images, known = [], [], np.array(found)
            v = start
            for _ in range(min(steps, n - len(found))):
                for _ in range(2):  # the second pass removes what rounding left
                    v = v - known.T @ (known @ v)
                    for u in basis:
                        v = v - u * (u @ v)
                size = np.linalg.norm(v)
                basis.append(v / size)
                images.append(product(basis[-1]))
                q, r = np.array(basis), np.array(images)
                small = q @ r.T
                values, vectors = np.linalg.eigh((small + small.T) / 2)
                best, image = vectors[:, -1] @ q, vectors[:, -1] @ r
                image = image - known.T @ (known @ image)
                residual = np.linalg.norm(image - values[-1] * best)
                v = images[-1] - known.T @ (known @ images[-1])
                v = v - q.T @ (q @ v)
                if residual <= tolerance * np.abs(values).max() or np.linalg.norm(v) <= 1e-13 * np.abs(values).max():
                    break
            if residual <= tolerance * np.abs(values).max() or len(basis) == n - len(found):
                break
            start = best if np.linalg.norm(v) > 1e-13 * np.abs(values).max() else best + 1e-3 * seed.standard_normal(n)
        found.append(best / np.linalg.norm(best))
        yield float(values[-1]), found[-1]


def member_sets(entries: DataFrame, member: str) -> DataFrame:
    """(hog_id, member): members of every group and all its ancestors, without repeats."""
    return entries.where("hog_id <> ''").select(F.explode(hogid.ancestor_ids("hog_id")).alias("hog_id"), F.col(member).alias("member")).where("member <> ''").distinct()


def forward_map(old: DataFrame, new: DataFrame, *, keep_all: float = 0.6) -> DataFrame:
    """(old_id, new_id, jaccard, dubious): where the groups of an older release went.

    Both inputs are (hog_id, member). Candidates are kept while the best of the old id is above
    ``keep_all``; a perfect match stands alone. Old ids with more than ten candidates
    of which the seventh is above 0.9 are dubious.
    """
    pairs = overlaps(old.withColumnRenamed("hog_id", "old_id"), new.withColumnRenamed("hog_id", "new_id"), left_key="old_id", right_key="new_id", item="member")
    scored = pairs.select("old_id", "new_id", jaccard().alias("jaccard"))
    w = Window.partitionBy("old_id")
    ranked = scored.withColumn("best", F.max("jaccard").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("jaccard"), "new_id")))
    kept = ranked.where((F.col("best") > keep_all) & ((F.col("best") < 1) | (F.col("jaccard") == 1)))
    n, seventh = F.count(F.lit(1)).over(w), F.max(F.when(F.col("r") == 7, F.col("jaccard"))).over(w)
    return kept.withColumn("dubious", (n > 10) & (F.coalesce(seventh, F.lit(0.0)) > 0.9)).select("old_id", "new_id", "jaccard", "dubious")


def profile_neighbours(profiles: DataFrame, key: str, item: str, queries: DataFrame, *, k: int = 50) -> DataFrame:
    """(query, key, jaccard): the ``k`` profiles most similar to each query profile, itself left out.

    ``profiles`` is (key, item) without repeats; ``queries`` lists keys.
    """
    q = profiles.join(queries.select(key).distinct(), key, "left_semi").withColumnRenamed(key, "query")
    pairs = overlaps(q, profiles, left_key="query", right_key=key, item=item).where(F.col("query") != F.col(key)).withColumn("jaccard", jaccard())
    w = Window.partitionBy("query").orderBy(F.desc("jaccard"), key)
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", key, "jaccard")


def clade_map(a: DataFrame, b: DataFrame, *, candidates: int = 50, cut: float = 0.4) -> DataFrame:
    """(clade1, clade2, dice): clades of two taxonomies matched by their species.

    Inputs are (clade, name, species). Per clade the best ``candidates`` within ``cut`` of the best
    one are compared by name, and the closest name wins among equal scores.
    """
    from phylolake.operators.idmap import match_score

    x, y = (d.select(F.col("clade").alias(f"clade{i}"), "species").distinct() for i, d in ((1, a), (2, b)))
    pairs = overlaps(x, y, left_key="clade1", right_key="clade2", item="species").withColumn("dice", dice())
    named = pairs.join(a.select(F.col("clade").alias("clade1"), F.col("name").alias("n1")).distinct(), "clade1").join(b.select(F.col("clade").alias("clade2"), F.col("name").alias("n2")).distinct(), "clade2")
    w = Window.partitionBy("clade1")
    top = named.withColumn("best", F.max("dice").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("dice"), "clade2"))).where((F.col("r") <= candidates) & (F.col("dice") >= cut * F.col("best")))
    best = top.withColumn("q", F.row_number().over(w.orderBy(F.desc("dice"), F.desc(match_score(F.col("n1"), F.col("n2"))), "clade2"))).where("q = 1")
    return best.select("clade1", "clade2", "dice")


def minhash_signature(sets: DataFrame, key: str, item: str, *, n: int = 128, seed: int = 1) -> DataFrame:
    """(key, signature): minimum of ``n`` seeded hashes over the items of every key, one aggregation."""
    h = [F.min(F.xxhash64(F.col(item), F.lit(seed * 100_003 + i))).alias(f"h{i}") for i in range(n)]
    return sets.groupBy(key).agg(*h).select(key, F.array(*[f"h{i}" for i in range(n)]).alias("signature"))


def signature_similarity(a, b):
    """Share of equal places of two signatures: an estimate of the Jaccard index."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)



def lsh_add(sets: DataFrame, key: str, item: str, *, bands: int = 34, rows: int = 4, seed: int = 7) -> DataFrame:
    """(key, items, bands): a stored index of minhash bands; rows of new sets can simply be appended to it.

    Two sets of Jaccard index j share a band with probability 1 - (1 - j^rows)^bands: 0.9999 at 0.7 with the defaults.
    """
    signed = minhash_signature(sets, key, item, n=bands * rows, seed=seed)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    items = sets.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return signed.select(key, band.alias("bands")).join(items, key).select(key, "items", "bands")


def lsh_query(index: DataFrame, queries: DataFrame, key: str, *, threshold: float = 0.7) -> DataFrame:
    """(query, key, jaccard): the sets of an index that overlap by at least ``threshold`` with those of ``queries`` (rows of the same
    form), a set with itself left out. Candidates share a band and are compared in full."""
    q = queries.select(F.col(key).alias("query"), F.col("items").alias("__q"), F.explode("bands").alias("__band"))
    hits = q.join(index.select(key, F.explode("bands").alias("__band")), "__band").where(F.col("query") != F.col(key)).select("query", key).distinct()
    full = hits.join(queries.select(F.col(key).alias("query"), F.col("items").alias("__a")), "query").join(index.select(key, F.col("items").alias("__b")), key)
    shared = F.size(F.array_intersect("__a", "__b"))
    scored = full.select("query", key, (shared / (F.size("__a") + F.size("__b") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold - 1e-12)
