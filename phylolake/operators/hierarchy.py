"""Trees and directed acyclic graphs given as (child, parent) tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.errors import InvalidTaxonomy
from phylolake.session import discard, spill

MAX_DEPTH = 100


def closure(edges: DataFrame, child: str, parent: str, nodes: DataFrame | None = None, node: str | None = None, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(descendant, ancestor, dist) with the shortest distance; every node is its own ancestor at 0.

    The distance doubles per round: a path of length n is found after log2(n)
    joins. ``nodes`` adds nodes without edges. A cycle, or a path longer than
    ``max_depth``, raises :class:`InvalidTaxonomy`. Edges with a null end and links of a node
    with itself are ignored. Meant for dimension tables (taxa, terms), any size.
    """
    e = edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).where("descendant IS NOT NULL AND ancestor IS NOT NULL AND descendant <> ancestor")
    ids = e.select(F.col("descendant").alias("n")).unionByName(e.select(F.col("ancestor").alias("n")))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col(node).alias("n")))
    own = ids.where("n IS NOT NULL").distinct().select(F.col("n").alias("descendant"), F.col("n").alias("ancestor"), F.lit(0).cast("bigint").alias("dist"))
    reach = spill(own.unionByName(e.distinct().withColumn("dist", F.lit(1).cast("bigint"))), "closure")
    n = reach.count()
    for _ in range(math.ceil(math.log2(max_depth)) + 1):
        left = reach.select("descendant", F.col("ancestor").alias("mid"), F.col("dist").alias("d1"))
        right = reach.select(F.col("descendant").alias("mid"), "ancestor", F.col("dist").alias("d2"))
        grown = left.join(right, "mid").groupBy("descendant", "ancestor").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"))
        grown = spill(grown, "closure")
        m = grown.count()
        discard(reach)
        reach = grown
        if m == n:
            back = e.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("ancestor"))
            if not reach.join(back, ["descendant", "ancestor"], "left_semi").isEmpty():
                raise InvalidTaxonomy("the parent table holds a cycle")
            if (reach.agg(F.max("dist")).first()[0] or 0) > max_depth:
                raise InvalidTaxonomy(f"a lineage is longer than {max_depth}")
            return reach
        n = m
    raise InvalidTaxonomy(f"a lineage is longer than {max_depth}")


def lineage(tree_closure: DataFrame, taxid) -> DataFrame:
    """(taxid, dist): the path of one node to the root, itself first."""
    return tree_closure.where(F.col("descendant") == taxid).select(F.col("ancestor").alias("taxid"), "dist")


def subtree(tree_closure: DataFrame, taxid) -> DataFrame:
    """(taxid, dist): all descendants of one node, itself at 0."""
    return tree_closure.where(F.col("ancestor") == taxid).select(F.col("descendant").alias("taxid"), "dist")


def children(tree: DataFrame, taxid, node: str = "taxid", parent: str = "parent_taxid") -> DataFrame:
    return tree.where((F.col(parent) == taxid) & (F.col(node) != taxid))


def leaves(tree: DataFrame, node: str = "taxid", parent: str = "parent_taxid", also: DataFrame | None = None) -> DataFrame:
    """Nodes without children, and the nodes in ``also`` (inner nodes that are genomes themselves)."""
    out = tree.select(node).join(tree.select(F.col(parent).alias(node)), node, "left_anti")
    return out if also is None else out.unionByName(tree.select(node).join(also.select(node), node, "left_semi")).distinct()


def with_single_root(tree: DataFrame, node: str = "taxid", parent: str = "parent_taxid", name: str = "name", root_id: int = 0, root_name: str = "LUCA") -> DataFrame:
    """A common root (parent -1) above several roots; a tree with one root stays as it is."""
    known = tree.select(F.col(node).alias(parent))
    roots = tree.join(known, parent, "left_anti").select(node)
    if roots.limit(2).count() < 2:
        return tree
    marked = tree.join(roots.withColumn("__r", F.lit(True)), node, "left").withColumn(parent, F.when(F.col("__r"), F.lit(root_id)).otherwise(F.col(parent))).drop("__r")
    luca = tree.sparkSession.range(1).select(F.lit(root_id).cast(tree.schema[node].dataType).alias(node), F.lit(-1).cast(tree.schema[parent].dataType).alias(parent), F.lit(root_name).alias(name))
    return marked.unionByName(luca, allowMissingColumns=True)


def induced_tree(tree_closure: DataFrame, members: DataFrame, *, node: str = "taxid", collapse: bool = False, keep: DataFrame | None = None, with_ancestors: bool = False) -> DataFrame:
    """(taxid, parent_taxid): the tree over ``members``, each linked to its nearest kept ancestor (null: none).

    ``with_ancestors`` first adds all ancestors of the members. ``collapse`` takes
    out nodes with a single child, unless ``keep`` (the genomes) holds them; the
    surviving set is found directly: a node stays if it is a member leaf, in
    ``keep``, or has members below at least two children.
    """
    m = members.select(F.col(node).alias("taxid")).distinct()
    if with_ancestors:
        m = m.join(tree_closure, m["taxid"] == tree_closure["descendant"]).select(F.col("ancestor").alias("taxid")).distinct()

    def link(kept: DataFrame) -> DataFrame:
        up = tree_closure.where("dist > 0").join(kept.withColumnRenamed("taxid", "ancestor"), "ancestor", "left_semi")
        near = up.groupBy("descendant").agg(F.min_by("ancestor", "dist").alias("parent_taxid"))
        return kept.join(near, kept["taxid"] == near["descendant"], "left").select("taxid", "parent_taxid")

    linked = link(m)
    if not collapse:
        return linked
    fan = linked.where("parent_taxid IS NOT NULL").groupBy(F.col("parent_taxid").alias("taxid")).agg(F.count(F.lit(1)).alias("__n"))
    single = fan.where("__n = 1").select("taxid")
    if keep is not None:
        single = single.join(keep.select(F.col(node).alias("taxid")), "taxid", "left_anti")
    return link(m.join(single, "taxid", "left_anti"))


def preorder(tree_closure: DataFrame, root, names: DataFrame, *, node: str = "taxid", name: str = "name") -> DataFrame:
    """(taxid, path, idx, depth): depth-first index of every node below ``root`` in order of names."""
    below = tree_closure.where(F.col("ancestor") == root).select("descendant")
    steps = tree_closure.join(below, "descendant", "left_semi").join(below.withColumnRenamed("descendant", "ancestor"), "ancestor", "left_semi")
    named = steps.join(names.select(F.col(node).alias("ancestor"), F.col(name).alias("__name")), "ancestor", "left")
    part = F.struct((-F.col("dist")).alias("o"), F.coalesce("__name", F.lit("")).alias("n"), F.col("ancestor").cast("string").alias("a"))
    path = F.transform(F.array_sort(F.collect_list(part)), lambda p: F.concat(p["n"], F.lit("\x01"), p["a"]))
    p = named.groupBy(F.col("descendant").alias("taxid")).agg(F.array_join(path, "\x00").alias("path"), (F.count(F.lit(1)) - 1).alias("depth"))
    return p.withColumn("idx", F.row_number().over(Window.orderBy("path")) - 1)


def leaf_ranges(tree_closure: DataFrame, leaf_index: DataFrame, *, leaf: str = "taxid", idx: str = "idx") -> DataFrame:
    """(ancestor, first, last, size): contiguous range of leaf numbers below every node."""
    j = tree_closure.join(leaf_index.select(F.col(leaf).alias("descendant"), F.col(idx).alias("__i")), "descendant")
    return j.groupBy("ancestor").agg(F.min("__i").alias("first"), F.max("__i").alias("last"), F.count(F.lit(1)).alias("size"))


def species_order(tree_closure: DataFrame, leaf_nodes: DataFrame, root, *, node: str = "taxid") -> DataFrame:
    """(taxid, shared, rank): species by the depth of the lineage shared with ``root``, deepest first."""
    mine = tree_closure.where(F.col("descendant") == root).select("ancestor")
    shared = tree_closure.join(mine, "ancestor", "left_semi").groupBy(F.col("descendant").alias("taxid")).agg(F.count(F.lit(1)).alias("shared"))
    paths = tree_closure.groupBy(F.col("descendant").alias("taxid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("__path"))
    out = leaf_nodes.select(F.col(node).alias("taxid")).join(shared, "taxid").join(paths, "taxid")
    return out.select("taxid", "shared", (F.row_number().over(Window.orderBy(F.desc("shared"), "__path")) - 1).alias("rank"))


# -- serialisers: trees are dimension tables, read after a size check ------------------


def _tree_dict(tree: DataFrame, node: str, parent: str, name: str, limit: int):
    rows = tree.select(node, parent, name).limit(limit + 1).collect()
    if len(rows) > limit:
        raise InvalidTaxonomy(f"more than {limit} nodes cannot be serialised on one machine")
    names, kids, known = {}, {}, {r[0] for r in rows}
    for t, p, n in rows:
        names[t] = n or str(t)
        kids.setdefault(p if p in known and p != t else None, []).append(t)
    for v in kids.values():
        v.sort(key=lambda t: names[t])
    return names, kids


def newick_name(name: str) -> str:
    """A name as newick allows it: blanks to underscores, round to square brackets, quoted if needed."""
    plain = name.translate(str.maketrans(" ()", "_[]"))
    return "'" + plain.replace("'", "''") + "'" if any(c in plain for c in ",:;'") else plain


def to_newick(tree: DataFrame, *, node: str = "taxid", parent: str = "parent_taxid", name: str = "name", species: dict | None = None, limit: int = 1_000_000) -> str:
    """Newick text; an inner node that is a species itself (``species``: id -> code) gets an extra leaf."""
    names, kids = _tree_dict(tree, node, parent, name, limit)
    species = species or {}

    def write(t):
        sub = [write(c) for c in kids.get(t, [])]
        if sub and t in species:
            sub.append(f"{newick_name(names[t])}_[disambiguate_{species[t]}]")
        return (f"({','.join(sub)})" if sub else "") + newick_name(names[t])

    roots = [write(t) for t in kids.get(None, [])]
    return (roots[0] if len(roots) == 1 else f"({','.join(roots)})") + ";"


def to_nested(tree: DataFrame, *, node: str = "taxid", parent: str = "parent_taxid", name: str = "name", limit: int = 1_000_000) -> dict:
    """Nested dictionaries {name, id, children}."""
    names, kids = _tree_dict(tree, node, parent, name, limit)

    def build(t):
        out = {"name": names[t], "id": t}
        if kids.get(t):
            out["children"] = [build(c) for c in kids[t]]
        return out

    roots = [build(t) for t in kids.get(None, [])]
    return roots[0] if len(roots) == 1 else {"name": "", "id": None, "children": roots}


def to_phyloxml(tree: DataFrame, *, node: str = "taxid", parent: str = "parent_taxid", name: str = "name", limit: int = 1_000_000) -> str:
    """PhyloXML text with one clade per node."""
    from xml.sax.saxutils import escape

    names, kids = _tree_dict(tree, node, parent, name, limit)

    def clade(t):
        sub = "".join(clade(c) for c in kids.get(t, []))
        return f"<clade><name>{escape(names[t])}</name><taxonomy><id provider=\"uniprot\">{t}</id></taxonomy>{sub}</clade>"

    return '<phyloxml xmlns="http://www.phyloxml.org"><phylogeny rooted="true">' + "".join(clade(t) for t in kids.get(None, [])) + "</phylogeny></phyloxml>"


def valid_level_name(col) -> Column:
    """Level names free of unusual characters."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~c.rlike(r"[^A-Za-z0-9()/_,.: \-]")
