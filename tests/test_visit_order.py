"""Walks in visit order against a queue, small and large levels, and folders of steps."""

import random

import pytest
from pyspark.sql import functions as F

from symgraph.operators import traversal

KINDS = ("calls", "imports")


def walk(edges, seeds, depth, reverse, kinds):
    out, seen, frontier = [], set(seeds), sorted(seeds)
    for d in range(1, depth + 1):
        after = []
        for at in frontier:
            for resolver, source, seq, target, kind in sorted(edges):
                here, there = (target, source) if reverse else (source, target)
                if here == at and there not in seen and (kinds is None or kind in kinds):
                    seen.add(there)
                    out.append((there, d, kind, at, len(out)))
                    after.append(there)
        frontier = after
    return out


@pytest.mark.parametrize("small, bucket_edges", [(100_000, 200_000), (3, 5), (0, 40)])
def test_walks_equal_a_queue(spark, monkeypatch, small, bucket_edges):
    monkeypatch.setattr(traversal, "SMALL", small)
    monkeypatch.setattr(traversal, "BUCKET_EDGES", bucket_edges)
    rng = random.Random(small)
    edges = list({(rng.randrange(3), rng.randrange(40), rng.randrange(4), rng.choice([0, rng.randrange(40)]), rng.choice(KINDS)) for _ in range(200)})
    df = spark.createDataFrame(edges, "resolver int, source_id long, seq long, target_id long, kind string")
    seeds = spark.createDataFrame([(0,), (7,), (7,), (99,)], "node long")
    for reverse in (False, True):
        near = traversal.step_index(df, reverse)
        for kinds in (None, ("calls",)):
            got = sorted((tuple(r) for r in traversal.visits(near, seeds, 3, kinds).collect()), key=lambda r: r[4])
            assert got == walk(edges, {0, 7, 99}, 3, reverse, kinds) and len(got) > 5


def test_empty_walks(spark):
    none = spark.createDataFrame([], "resolver int, source_id long, seq long, target_id long, kind string")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert traversal.visits(traversal.step_index(none), seeds, 3).collect() == []
    assert traversal.visits(traversal.step_index(none), seeds.limit(0), 3).collect() == []
    assert traversal.visits(traversal.step_index(none), seeds, 0).columns == ["node", "depth", "edge_kind", "parent", "visit_ord"]


def test_a_lookup_opens_the_folders_of_its_frontier_alone(spark, monkeypatch):
    monkeypatch.setattr(traversal, "BUCKET_EDGES", 100)
    chain = spark.range(2000).select(F.lit(0).alias("resolver"), F.col("id").alias("source_id"), F.lit(0).cast("long").alias("seq"), (F.col("id") + 1).alias("target_id"), F.lit("calls").alias("kind"))
    near = traversal.step_index(chain)
    read = near.where(F.col("bucket").isin([3]))
    assert 0 < read.count() < near.count() / 5
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()
    found = traversal.visits(near, spark.createDataFrame([(5,)], "node long"), 4)
    assert [(r.node, r.parent) for r in found.orderBy("visit_ord").collect()] == [(6, 5), (7, 6), (8, 7), (9, 8)]
