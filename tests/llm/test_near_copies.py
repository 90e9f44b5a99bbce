import random

import numpy as np
import pytest

import corpus_pipeline
from symgraph import storage
from symgraph.llm import components, minhash, near_copies, simhash

SCHEMA = "doc_id long, text string"


def _edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _least_ids(rows):
    sets = {i: _shingles(t) for i, t in rows}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {k: new if v == old else v for k, v in name.items()}
    return name


def _rows():
    rng = random.Random(5)
    rows = []
    for i in range(0, 600, 6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 400))]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + ["more"]))]
        rows += [(i + k, " ".join(_edited(rng, base, max(1, round(len(base) * share))))) for k, share in enumerate((0.01, 0.02, 0.03, 0.06), 2)]
    return rows


@pytest.mark.parametrize("cell_tile, set_tile", [(near_copies.TILE, 500), (3, 2)])
def test_groups_equal_brute_force(spark, cell_tile, set_tile):
    rows = _rows()
    got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), cell_tile=cell_tile, set_tile=set_tile).collect()
    want = _least_ids(rows)
    assert {r.doc_id: r.component for r in got} == want and len(set(want.values())) > 120


def test_stage_finds_candidates_by_simhash_in_the_gray_ordered_index(spark, sf, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(_edited(rng, base, 1))), (3, " ".join(base).upper())], SCHEMA)
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf).collect())
    assert kept() == [1]
    search = near_copies._candidates  # over no fingerprints it leaves equal sets only
    monkeypatch.setattr(near_copies, "_candidates", lambda distinct, tile: search(distinct.limit(0), tile))
    assert kept() == [1, 2]


def test_crowded_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(_edited(rng, base, 2))) for i in range(60)]
    assert {r.component for r in near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), cell_tile=7, set_tile=7).collect()} == {0}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, " \n"), (3, "Two words"), (4, "two  WORDS"), (5, text), (None, text), (5, text + " more"), (6, "x " * 60000), (None, "alone at last")]
    got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.component) for r in got))) == sorted(map(str, [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, 5), (5, 5), (6, 6), (None, None)]))
    assert near_copies.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), least=0.7)


@pytest.mark.parametrize("left, right, both, share", [(4, 5, 4, 0.995), (9, 9, 8, 0.999), (90, 90, 80, 0.999), (80, 100, 80, 0.999)])
def test_pairs_at_the_bound_share_a_cell_and_stay_within_its_bits(left, right, both, share):
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, left + right, np.uint64) * np.uint64(2)
        x, y = near_copies.fingerprints(h[:left]), near_copies.fingerprints(np.concatenate([h[:both], h[left : left + right - both]]))
        apart, bits = x ^ y, np.bitwise_count(x ^ y)
        agree = [(apart & np.uint64(((1 << w) - 1) << a)) == 0 for a, w in simhash._segments(near_copies.PARTS)]
        found += bool((np.any(agree, axis=0) & (bits <= near_copies.MOST) & (bits + np.roll(bits, -1) <= near_copies.BOTH)).any())
    assert found >= share * 2000


def test_small_tables_come_in_few_files_however_many_shuffle_partitions(spark, monkeypatch):
    written = []

    def counted(df, name, *args, **more):
        got = storage.materialize(df, name, *args, **more)
        written.append((name, len(got.inputFiles())))
        return got

    for module in (components, minhash, near_copies):
        monkeypatch.setattr(module, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = _rows()[:120]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA), set_tile=2).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component for r in got} == _least_ids(rows)
    made = [n for name, n in written if name != "set-fingerprints"]  # as many as the input's partitions
    assert len(made) > 10 and max(made) == 1


def test_bound_on_files_grows_with_the_rows():
    assert [storage.files_for(n, 1000) for n in (0, 1, 1000, 1001, 46_000)] == [1, 1, 1, 2, 46]


def test_contracted_components_equal_those_of_the_plain_loop(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000 + i, 3000) for i in range(40)] + [(5, 5), (None, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = {r.node: r.component for r in components.connected_components(edges).collect()}
    got = components.contracted_components(edges, len(pairs)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.contracted_components(edges.limit(0), 0).count() == 0


def test_rounds_join_what_lies_between_groups_only(spark, monkeypatch):
    """A hub of many members costs its links once, not once for each round that a chain beside it takes."""
    joined = []

    def counted(df, name, *args, **more):
        got = storage.materialize(df, name, *args, **more)
        joined.append((name, got.count()))
        return got

    monkeypatch.setattr(components, "materialize", counted)
    pairs = [(i, 0) for i in range(1, 500)] + [(1001 + i, 1000 + i * 37 % 64) for i in range(64)]
    components.contracted_components(spark.createDataFrame(pairs, "a long, b long"), len(pairs)).count()
    assert sum(n for name, n in joined if name == "edges") <= 2 * len(pairs)
