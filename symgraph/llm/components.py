"""Connected components by repeated minimum and pointer jumping, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.storage import discard, files_for, materialize

#: Links or labels in one file, where their number is known.
ROWS = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges(a, b); the component is its smallest node.

    Null ends are dropped; loops and repeated edges do no harm; no edges give no rows.
    Each round takes the least label among a node's own, its neighbours' and its label's
    label, so chains shrink by half or more a round. Labels live in written tables.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("mid"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = taken.join(up, taken.mid == up.up, "left").select("node", F.col("label").alias("was"), F.least("mid", F.coalesce("top", "mid")).alias("label"))
        jumped = materialize(jumped, "labels")
        moved = jumped.where("was <> label").limit(1).count()
        discard(labels)
        labels = jumped.select("node", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))



def contracted_components(edges: DataFrame, about: int, max_rounds: int = 64) -> DataFrame:
    """As connected_components, for edges of which most lead to few nodes: each round goes on with what lies between the groups of the last.

    A node points at its least neighbour if that is smaller, pointers are followed to their
    ends, and edges become edges between these ends. A node that no pointer leads to has a
    smaller neighbour in the next round, so two rounds halve the nodes at least. about is
    the number of edges, roughly: tables come in as few files as their rows fill.
    """
    ends = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    edges = edges.where("a is not null and b is not null and a <> b").select(*ends("a", "b")).distinct()
    edges = materialize(edges, "edges", files=files_for(about, ROWS))
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        rows = edges.count()
        if not rows and levels:
            break
        files = files_for(rows, ROWS)
        tops = materialize(edges.groupBy("a").agg(F.min("b").alias("top")).select(F.col("a").alias("node"), "top"), "tops", files=files)
        moved = rows
        while moved:
            above = tops.select(F.col("node").alias("up"), F.col("top").alias("over"))
            jumped = materialize(tops.join(above, tops.top == above.up, "left").select("node", F.col("top").alias("was"), F.coalesce("over", "top").alias("top")), "tops", files=files)
            moved = jumped.where("was <> top").limit(1).count()
            discard(tops)
            tops = jumped.select("node", "top")
        levels.append(tops)
        if not rows:
            break
        low = tops.select(F.col("node").alias("low"), F.col("top").alias("low_top"))
        between = edges.join(tops, edges.a == tops.node).join(low, edges.b == low.low, "left").select(*ends(F.col("top"), F.coalesce("low_top", "b"))).where("a <> b").distinct()
        between = materialize(between, "edges", files=files)
        discard(edges)
        edges = between
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = levels.pop()
    while levels:
        under, above = levels.pop(), labels.select(F.col("node").alias("up"), F.col("top").alias("over"))
        labels = labels.union(under.join(above, under.top == above.up, "left").select("node", F.coalesce("over", "top").alias("top")))
    labels = labels.select("node", F.col("top").alias("component"))
    return labels.union(labels.select("component", "component").distinct())


def local_forest(a, b):
    """A spanning forest of the pairs (a, b), numpy arrays of integers: pairs (node, root)."""
    import numpy as np

    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == was).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
