"""Breadth-first traversal over an edge table: callers, callees, blast radius, ranked context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.storage import fresh_path, materialize

MAX_DEPTH = 10
CALLS = ("calls",)
#: Nodes of a frontier that are few enough to send to every task.
SMALL = 100_000
#: Edges around ten seeds that are few enough to replay on the driver, some 100 MB.
GATHERED = 500_000


def steps(edges: DataFrame, reverse: bool = False, kinds: tuple[str, ...] | None = None, both: bool = False) -> DataFrame:
    """(at, node, kind): where each edge leads."""
    here = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    near = here.select(F.col("target_id" if reverse else "source_id").alias("at"), F.col("source_id" if reverse else "target_id").alias("node"), "kind")
    return near.union(near.select(F.col("node").alias("at"), F.col("at").alias("node"), "kind")) if both else near


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, kinds: tuple[str, ...] | None = None, both: bool = False, written: bool = False) -> DataFrame:
    """(node, depth, edge_kind) reached from seeds(node) within depth steps, seeds left out.

    A node counts at its first visit, over the edge kind that comes first by name there.
    Every level is one join and one anti join over a written table of edges (the given one
    if it is `written`); a frontier of at most SMALL nodes, as counted, is broadcast. Visited
    nodes are written tables too, so the plan does not grow. Depth is capped at MAX_DEPTH.
    """
    near = steps(edges, reverse, kinds, both)
    near = near if written else materialize(near, "steps")
    found = [materialize(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_kind")), "level")]
    size = found[0].count()
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = found[-1].select(F.col("node").alias("from"))
        known = found[0].select("node")
        for each in found[1:]:
            known = known.union(each.select("node"))
        fresh = near.join(F.broadcast(frontier) if size <= SMALL else frontier, F.col("at") == F.col("from"), "left_semi").groupBy("node").agg(F.min("kind").alias("edge_kind"))
        step = materialize(fresh.join(known, "node", "left_anti").select("node", F.lit(level).alias("depth"), "edge_kind"), "level")
        size = step.count()  # read from the files' footers
        if not size:
            break
        found.append(step)
    out = found[0].where("depth > 0")
    for each in found[1:]:
        out = out.union(each)
    return out


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 2, kinds: tuple[str, ...] = CALLS, written: bool = False) -> DataFrame:
    """What leads to the seeds over calls (or over the kinds that stand for them in another graph)."""
    return bfs(edges, seeds, depth, reverse=True, kinds=kinds, written=written)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 2, kinds: tuple[str, ...] = CALLS, written: bool = False) -> DataFrame:
    """What the seeds lead to over calls."""
    return bfs(edges, seeds, depth, kinds=kinds, written=written)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, children: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Everything that leads to the seeds, or to their direct children(parent_id, node), over any edge kind."""
    return bfs(edges, seeds if children is None else with_children(seeds, children), depth, reverse=True, written=written)


def with_children(seeds: DataFrame, children: DataFrame) -> DataFrame:
    """seeds(node) and their direct children(parent_id, node)."""
    return seeds.select("node").union(children.join(seeds, children.parent_id == seeds.node, "left_semi").select(children.node))


#: The order in which edges are followed: that in which resolvers wrote them.
WRITTEN = ("resolver", "source_id", "seq", "target_id")
#: Edges of a bucket of a written table of steps, and buckets at most.
BUCKET_EDGES, MOST_BUCKETS = 200_000, 4096


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def step_index(edges: DataFrame, reverse: bool = False, order: tuple[str, ...] = WRITTEN) -> DataFrame:
    """Where each edge leads, (at, node, kind, ord, bucket), written once for many traversals in folders by a hash of `at`.

    A traversal opens the folders of its frontier alone: looking up a few nodes does not read the graph.
    """
    at, node = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    near = edges.select(F.col(at).alias("at"), F.col(node).alias("node"), "kind", F.struct(*order).alias("ord"))
    buckets = max(1, min(MOST_BUCKETS, edges.count() // BUCKET_EDGES))
    near = near.withColumn("bucket", _bucket(F.col("at"), buckets))
    path = fresh_path(edges.sparkSession, f"steps-{buckets}")
    # Rebalancing splits the folder of a hub over several tasks and files.
    dealt = edges.sparkSession.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {near}", near=near)
    dealt.sortWithinPartitions("bucket", "at").write.partitionBy("bucket").parquet(path)
    return edges.sparkSession.read.schema(near.schema).parquet(path).withColumn("buckets", F.lit(buckets))


def _numbered(level: DataFrame, size: int) -> DataFrame:
    """level(visit, ...) with rank: its place from 0 by visit.

    A level of at most SMALL rows is one sort. A larger one is numbered by ranges: each range is a
    partition, the ranges' totals (one row each) are summed, and a window counts inside one.
    """
    if size <= SMALL:
        return level.withColumn("rank", (F.row_number().over(Window.orderBy("visit")) - 1).cast("long"))
    ranged = materialize(level.repartitionByRange("visit").withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(F.count("*").alias("n"))
    ahead = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("visit")) - 1
    return ranged.join(F.broadcast(ahead), "range").withColumn("rank", F.col("before") + place).drop("range", "before")


def visits(near: DataFrame, seeds: DataFrame, depth: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(node, depth, edge_kind, parent, visit_ord) of a breadth-first walk in its own order, seeds left out.

    The walk takes the nodes of a level as they were visited, and the edges of each as near, a step_index(),
    orders them; a node counts where it is first met, which gives its parent and edge kind. visit_ord
    counts from 0 over all levels. Seeds go by their id, each once. Every level writes its nodes
    with the least (rank of the node before, order of the edge), which partial aggregation finds before any
    shuffle; ranks are numbered from that. Depth is capped at MAX_DEPTH.
    """
    if kinds is not None:
        near = near.where(F.col("kind").isin(*kinds))
    first = seeds.select("node").distinct().select("node", F.struct("node").alias("visit"))
    level = materialize(first, "visits")
    size = level.count()
    known, out, total = level.select("node"), [], 0
    ranked = _numbered(level, size)
    held = near.select("buckets").first() if "buckets" in near.columns else None
    for step in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = ranked.select(F.col("node").alias("from"), "rank")
        here = near
        if size <= SMALL and held:
            # At most MOST_BUCKETS numbers come to the driver.
            wanted = [r.b for r in frontier.select(_bucket(F.col("from"), held.buckets).alias("b")).distinct().collect()]
            here = near.where(F.col("bucket").isin(wanted)) if len(wanted) < held.buckets else near
        met = here.join(F.broadcast(frontier) if size <= SMALL else frontier, F.col("at") == F.col("from"))
        met = met.groupBy("node").agg(F.min(F.struct("rank", "ord", "kind", "at")).alias("visit"))
        level = materialize(met.join(known, "node", "left_anti"), "visits")
        size = level.count()  # read from the files' footers
        if not size:
            break
        ranked = _numbered(level, size)
        out.append(ranked.select("node", F.lit(step).alias("depth"), F.col("visit.kind").alias("edge_kind"), F.col("visit.at").alias("parent"), (F.col("rank") + total).alias("visit_ord")))
        known, total = known.union(level.select("node")), total + size
    if not out:
        kind = seeds.schema["node"].dataType.simpleString()
        return seeds.sparkSession.createDataFrame([], f"node {kind}, depth int, edge_kind string, parent {kind}, visit_ord long")
    return reduce(DataFrame.union, out)


def impact_counts(reached: DataFrame) -> DataFrame:
    """Direct nodes, and all of them."""
    return reached.agg(F.count_if(F.col("depth") == 1).alias("direct_count"), F.count("*").alias("transitive_count"))


def kind_boost(kind: Column) -> Column:
    return F.when(kind.isin("class", "interface", "component"), 2.0).when(kind.isin("enum", "hook", "type"), 1.0).otherwise(0.0)


def context_score(seed_rank: Column, depth: Column, kind: Column, has_endpoint: Column) -> Column:
    """Search rank of a seed, nearness, kind, and whether it serves an endpoint."""
    rank = F.when((depth == 0) & seed_rank.isNotNull(), 10 - seed_rank).otherwise(0)
    return rank * 3 + 1 / (depth + 1) + kind_boost(kind) + F.when(has_endpoint, 3.0).otherwise(0.0)


def expand_seeds(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth, seed_rank) by expanding ranked seeds(node, seed_rank) one after another, both ways.

    A node belongs to the first seed that reaches it: what an earlier seed reached blocks
    later ones. A seed that was reached already keeps its place and is expanded nevertheless. At most ten
    seeds, two levels each. What all of them can reach is gathered at once, and the seeds are replayed over it in
    order where it is at most GATHERED edges, as counted; beyond that each new frontier is written, seed by seed.
    """
    spark = edges.sparkSession
    kind = seeds.schema["node"].dataType.simpleString()
    order = seeds.orderBy("seed_rank").limit(10).collect()  # ten rows at most
    near = materialize(edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("node")).union(edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("node"))).distinct(), "steps")
    pairs = _around(near, seeds.select("node"), depth)
    if pairs is not None:
        return spark.createDataFrame(_replayed(pairs, [(r["node"], r["seed_rank"]) for r in order], depth), f"node {kind}, depth int, seed_rank int")
    found: list[DataFrame] = []
    reached: set = set()  # those of the ten seeds that were reached so far
    for row in order:
        level = spark.createDataFrame([(row["node"], 0, row["seed_rank"])], f"node {kind}, depth int, seed_rank int")
        if row["node"] not in reached:
            reached.add(row["node"])
            found.append(level)
        size = 1
        for step in range(1, depth + 1):
            frontier = level.select(F.col("node").alias("from"))
            fresh = near.join(F.broadcast(frontier) if size <= SMALL else frontier, F.col("at") == F.col("from"), "left_semi").select("node").distinct()
            known = found[0].select("node")
            for each in found[1:]:
                known = known.union(each.select("node"))
            level = materialize(fresh.join(known, "node", "left_anti").select("node", F.lit(step).alias("depth"), F.lit(row["seed_rank"]).cast("int").alias("seed_rank")), "level")
            size = level.count()
            if not size:
                break
            found.append(level)
            reached |= {r.node for r in level.where(F.col("node").isin([s["node"] for s in order])).collect()}
    out = spark.createDataFrame([], f"node {kind}, depth int, seed_rank int")
    for each in found:
        out = out.union(each)
    return out


def _around(near: DataFrame, seeds: DataFrame, depth: int) -> list | None:
    """All (at, node) that walks of so many steps from the seeds take together, or None where they are more than GATHERED."""
    pairs, frontier, total = [], seeds, 0
    for _ in range(depth):
        step = materialize(near.join(F.broadcast(frontier.select(F.col("node").alias("from"))), F.col("at") == F.col("from"), "left_semi"), "around")
        total += step.count()  # read from the files' footers, ahead of any row
        if total > GATHERED:
            return None
        held = step.select("at", "node").toArrow()
        pairs += zip(held.column(0).to_pylist(), held.column(1).to_pylist())
        frontier = step.select("node").distinct()
    return pairs


def _replayed(pairs: list, order: list, depth: int) -> list[tuple]:
    """(node, depth, seed_rank): the seeds expanded one after another over pairs(at, node)."""
    beside: dict = {}
    for at, node in pairs:
        beside.setdefault(at, set()).add(node)
    visited: dict = {}
    for seed, rank in order:
        visited.setdefault(seed, (0, rank))
        frontier = {seed}
        for step in range(1, depth + 1):
            frontier = {n for at in frontier for n in beside.get(at, ()) if n not in visited}
            visited.update((n, (step, rank)) for n in frontier)
    return [(n, d, r) for n, (d, r) in visited.items()]


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, name, kind, module, direction, edge_kind, other): a row for each edge at either end of a node, one for a node without any.

    Edges are rows, so that a node with very many of them is no group of its own.
    """
    ends = edges.select(F.col("target_id").alias("end"), F.lit("in").alias("direction"), F.col("kind").alias("edge_kind"), F.col("source_id").alias("other"))
    ends = ends.union(edges.select("source_id", F.lit("out"), "kind", "target_id"))
    return nodes.select("node", "name", "kind", "module").join(ends, F.col("node") == F.col("end"), "left").drop("end")


def build_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, endpoints: DataFrame | None = None, max_nodes: int = 20) -> DataFrame:
    """The best nodes(node, name, kind, module) around ranked seeds, with their scores; ties go to the earlier seed, the nearer node, its id."""
    visited = expand_seeds(edges, seeds)
    served = endpoints.select("node").distinct().withColumn("serves", F.lit(True)) if endpoints is not None else None
    out = nodes.join(visited, "node")
    out = out.join(served, "node", "left") if served is not None else out.withColumn("serves", F.lit(False))
    scored = out.withColumn("score", context_score(F.col("seed_rank"), F.col("depth"), F.col("kind"), F.coalesce("serves", F.lit(False))))
    return scored.select("node", "name", "kind", "module", "depth", "seed_rank", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "seed_rank", "depth", "node").limit(max_nodes).drop("seed_rank")
