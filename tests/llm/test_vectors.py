import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, kept string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def _brute(rows, bound=0.98):
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    name, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    pairs = [(a, b) for a, x, l in good for b, y, m in good if a != b and l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= bound]
    for a, _ in pairs:
        links[a] += 1
    for _ in range(len(rows)):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    return sorted(((i, links[i], name[i], name[i] == i) for i, _, _ in rows), key=repr)


@pytest.mark.parametrize("pivots,tile", [(1, 1024), (7, 16), (None, 64)])
def test_links_and_components_equal_brute_force(spark, pivots, tile):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(12):
        seed = rng.normal(size=16)
        for _ in range(rng.integers(1, 15)):
            v = (seed + rng.normal(size=16) * rng.choice([0, 0.08, 0.15])) * rng.choice([1.0, 3.0])
            rows.append((n, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
            n += 1
    same = rows[0][1]
    rows += [(n + i, same, rows[0][2]) for i in range(40)]
    n += 40
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, same, None), (n + 5, [1.0, None], 1), (n + 6, [1.0, 0.0], 0), (n + 7, [2.0, 0.0], 0), (n + 8, [float("inf")] * 16, 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(_table(spark, rows), pivots=pivots, tile=tile).collect()), key=repr)
    assert got == _brute(rows)


def test_null_ids_and_empty_tables(spark):
    assert V.near_duplicates(_table(spark, [])).count() == 0
    got = V.near_duplicates(_table(spark, [(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (6, [-1.0, 2.0], 1)])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True)], key=repr)


def test_more_than_64_lengths_in_one_plan(spark):
    rows = [(3 * d + k, [1.0] * d + [0.01 * k], 1) for d in range(1, 90) for k in range(3)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(_table(spark, rows), pivots=5, tile=16).collect()), key=repr)
    assert got == _brute(rows)


def test_double_components_and_dense_groups(spark):
    rng = np.random.default_rng(4)
    seed = rng.normal(size=8)
    rows = [(i, [float(x) for x in seed + rng.normal(size=8) * 0.02], 1) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(table, tile=32).collect()), key=repr) == _brute(rows)


def test_windows_and_leaves_prune_pairs_and_lose_none(spark):
    """By default several pivots are at work at any size; clusters are not compared with each other."""
    rng = np.random.default_rng(7)
    seeds = rng.normal(size=(12, 24))
    rows = [(i, [float(np.float32(x)) for x in seeds[i % 12] + rng.normal(size=24) * 0.05], 1) for i in range(900)]
    table = _table(spark, rows)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(table).collect()), key=repr)
    assert got == _brute(rows) and sum(r[1] for r in got) > 5000
    packed, kind = V.pack(table.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")))
    found = V.near_links(packed.withColumn("copies", F.lit(1).cast("long")), kind, 0.98)
    assert 900 * 60 < found.agg(F.sum("compared")).first()[0] < 0.4 * 900 * 900
