"""Clean-up of synteny graphs, one connected piece at a time, and component labels.

The edits are sequential by nature: each one changes the degrees the next looks at.
They run per component in Arrow-fed Python; the components themselves are found in
Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.session import discard, ship_package, spill


def component_labels(edges: DataFrame, a: str = "node1", b: str = "node2") -> DataFrame:
    """(node, component): smallest node of the connected piece, by min-label rounds with shortcuts."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    label = spill(both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        hop = label.join(near, "x").select("x", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        far = hop.join(label.select(F.col("x").alias("l"), F.col("l").alias("ll")), "l", "left").select("x", F.coalesce(F.least("l", "ll"), "l").alias("l"), "old")
        new = spill(far, "labels")
        changed = new.where("l <> old").limit(1).count()
        discard(label)
        label = new.select("x", "l")
        if not changed:
            return label.select(F.col("x").alias("node"), F.col("l").alias("component"))


class Graph:
    """Undirected weighted graph of one component."""

    def __init__(self, edges):
        self.adj: dict = {}
        for u, v, w in edges:
            self.add(u, v, w)

    def add(self, u, v, w):
        self.adj.setdefault(u, {})[v] = w
        self.adj.setdefault(v, {})[u] = w

    def cut(self, u, v):
        self.adj[u].pop(v, None)
        self.adj[v].pop(u, None)

    def drop(self, u):
        for v in list(self.adj[u]):
            self.cut(u, v)
        del self.adj[u]

    def degree(self, u):
        return len(self.adj.get(u, ()))

    def edges(self):
        return [(u, v, w) for u in sorted(self.adj) for v, w in sorted(self.adj[u].items()) if u < v]


def contract_parentless(g: Graph, parentless) -> Graph:
    """Nodes without a parent and with two neighbours are bridged by an edge of the larger weight, one after
    the other; a node whose neighbours are already joined stays."""
    for u in sorted(n for n in g.adj if n in parentless):
        if g.degree(u) == 2:
            (x, wx), (y, wy) = sorted(g.adj[u].items())
            if y not in g.adj[x]:
                g.drop(u)
                g.add(x, y, max(wx, wy))
    return g


def drop_weak_edges(g: Graph, min_importance: float = 10.0, max_neighbours: int = 10) -> Graph:
    """Weak edges (below ``min_importance`` - 2, at least 1.001) of nodes with two or more important ones go.

    A node without that but with too many neighbours only marks its weak edges; an
    edge that both ends mark goes as well.
    """
    floor = max(min_importance - 2, 1.001)
    marked: set = set()
    for u in sorted(g.adj):
        weak = [v for v, w in sorted(g.adj[u].items()) if w < floor]
        if sum(w >= min_importance for w in g.adj[u].values()) >= 2:
            gone = weak
        elif g.degree(u) > max_neighbours:
            key = {v: (min(u, v), max(u, v)) for v in weak}
            gone = [v for v in weak if key[v] in marked]
            marked.update(key.values())
        else:
            gone = []
        for v in gone:
            g.cut(u, v)
    return g


def _path(g: Graph, start, end, without) -> list | None:
    """A shortest path that does not use the edge ``without``; None if there is none."""
    before, front = {start: None}, [start]
    while front and end not in before:
        new = []
        for u in front:
            for v in sorted(g.adj[u]):
                if v not in before and {u, v} not in without:
                    before[v] = u
                    new.append(v)
        front = new
    if end not in before:
        return None
    path = [end]
    while path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1]


def resolve_forks(g: Graph) -> Graph:
    """Neighbours of degree three each that are also joined by exactly one detour lose their direct edge.

    Its weight goes to every edge of the detour. The detour is the only one if
    cutting any of its edges separates the two nodes.
    """
    corners = sorted(u for u in g.adj if g.degree(u) == 3)
    for u, v in [(u, v) for u in corners for v in sorted(g.adj[u]) if u < v and v in set(corners)]:
        if v not in g.adj[u]:
            continue
        detour = _path(g, u, v, [{u, v}])
        if detour is None:
            continue
        steps = list(zip(detour, detour[1:], strict=False))
        if any(_path(g, u, v, [{u, v}, {x, y}]) is not None for x, y in steps):
            continue
        w = g.adj[u][v]
        g.cut(u, v)
        for x, y in steps:
            g.add(x, y, g.adj[x][y] + w)
    return g


def clean_graph(edges: DataFrame, parentless: DataFrame | None = None, *, steps: tuple[str, ...] = ("contract", "weak", "forks"), min_importance: float = 10.0, max_neighbours: int = 10) -> DataFrame:
    """(node1, node2, weight) after the edits, applied to every component on its own.

    ``parentless`` lists nodes (column node) that may be contracted.
    """
    ship_package(edges.sparkSession)
    comp = component_labels(edges)
    e = edges.select("node1", "node2", F.col("weight").cast("double").alias("weight"))
    e = e.join(comp.select(F.col("node").alias("node1"), "component"), "node1")
    flag = e.select("node1", "node2", "weight", "component")
    if parentless is not None:
        p = parentless.select("node").distinct().withColumn("p", F.lit(True))
        flag = flag.join(p.toDF("node1", "p1"), "node1", "left").join(p.toDF("node2", "p2"), "node2", "left")
    else:
        flag = flag.withColumn("p1", F.lit(False)).withColumn("p2", F.lit(False))
    kind = dict(edges.dtypes)["node1"]

    def run(pdf):
        g = Graph(sorted(zip(pdf["node1"], pdf["node2"], pdf["weight"], strict=True)))
        free = set(pdf.loc[pdf["p1"].fillna(False).astype(bool), "node1"]) | set(pdf.loc[pdf["p2"].fillna(False).astype(bool), "node2"])
        for s in steps:
            g = contract_parentless(g, free) if s == "contract" else drop_weak_edges(g, min_importance, max_neighbours) if s == "weak" else resolve_forks(g)
        return pd.DataFrame(g.edges(), columns=["node1", "node2", "weight"])

    return flag.groupBy("component").applyInPandas(run, f"node1 {kind}, node2 {kind}, weight double")
