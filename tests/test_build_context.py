from collections import defaultdict

import duckdb
import pytest

from symgraph.operators import search as S
from symgraph.operators import traversal
from symgraph.plans import catalog
from symgraph.plans import ordergraph as G


def _small_orders(spark, tmp_path):
    """Twelve suppliers in nations of their own, and two parts that only an order joins."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("region", [(i, f"R{i}") for i in range(13)], "r_regionkey int, r_name string")
    put("nation", [(i, f"N{i}", i) for i in range(13)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "Customer#1", 12, "X")], "c_custkey int, c_name string, c_nationkey int, c_mktsegment string")
    put("supplier", [(i, f"Supplier#{i}", i) for i in range(12)], "s_suppkey int, s_name string, s_nationkey int")
    put("part", [(1, "supplier bolt", "B"), (2, "nut", "B")], "p_partkey int, p_name string, p_brand string")
    put("orders", [(5, 1, "1-URGENT")], "o_orderkey int, o_custkey int, o_orderpriority string")
    put("lineitem", [(5, 1, 3), (5, 2, 4)], "l_orderkey int, l_partkey int, l_suppkey int")
    return str(tmp_path)


def test_context_equals_a_brute_force_walk(spark, tmp_path):
    sf = _small_orders(spark, tmp_path)
    nodes = {r.node: r for r in G.nodes(spark, sf).collect()}
    near = defaultdict(set)
    for e in G.edges(spark, sf).collect():
        near[e.source_id].add(e.target_id)
        near[e.target_id].add(e.source_id)
    seeds = [r.node for r in S.search(G.nodes(spark, sf), "supplier", "node", ["name"], limit=10).orderBy("rank", "node").collect()]
    visited: dict = {}
    for rank, seed in enumerate(seeds):
        visited.setdefault(seed, (0, rank))  # one that was reached already is expanded nevertheless
        frontier = [seed]
        for depth in (1, 2):
            frontier = [n for n in {m for f in frontier for m in near[f]} if n not in visited]
            visited.update((n, (depth, rank)) for n in frontier)
    score = lambda d, r: round((3 * (10 - r) if d == 0 else 0) + 1 / (d + 1), 6)
    want = [(s, d, n) for s, _, d, n in sorted((-score(d, r), r, d, n) for n, (d, r) in visited.items() if n in nodes)[:20]]  # ties in the order of the walk
    got = [(-r.score, r.depth, r.node) for r in catalog.QUERIES["build_context"](spark, sf).collect()]
    assert got == want and len(seeds) == 10
    assert (0, "part:1") in {(d, n) for _, d, n in got} and (1, "order:5") in {(d, n) for _, d, n in got}


@pytest.mark.parametrize("small", [500_000, 3])
def test_a_seed_that_was_reached_is_expanded(spark, monkeypatch, small):
    """Chain 1-2-3-4-5-6: seed 1 reaches 2 and 3; seed 3 goes on from there under its own rank."""
    monkeypatch.setattr(traversal, "GATHERED", small)
    edges = spark.createDataFrame([(i, i + 1, "calls") for i in range(1, 6)], "source_id long, target_id long, kind string")
    seeds = spark.createDataFrame([(1, 0), (3, 1)], "node long, seed_rank int")
    got = sorted((r.node, r.depth, r.seed_rank) for r in traversal.expand_seeds(edges, seeds).collect())
    assert got == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 1, 1), (5, 2, 1)]


def test_context_equals_sql(spark, sf):
    got = catalog.QUERIES["build_context"](spark, sf)
    names = got.columns
    with duckdb.connect() as db:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            db.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf}/{t}.parquet')")
        wanted = db.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES['build_context']})").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got.collect())
