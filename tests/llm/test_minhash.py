import random

import pytest

import corpus_pipeline
from symgraph.llm import minhash

SCHEMA = "doc_id long, text string"


def _edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _least_ids(rows, least=0.8):
    sets = {i: _shingles(t) for i, t in rows}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {k: new if v == old else v for k, v in name.items()}
    return name


def _rows():
    rng = random.Random(11)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * i, " ".join(base)))
        for k, share in enumerate((0.002, 0.01, 0.02, 0.03, 0.06), 1):
            rows.append((10 * i + k, " ".join(_edited(rng, base, max(1, round(len(base) * share))))))
    return rows


def test_groups_equal_brute_force_at_five_words(spark):
    rows = _rows()
    got = {r.doc_id: r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _least_ids(rows)
    assert got == want and len(set(want.values())) > 40


def test_pipeline_stage_drops_copies_of_one_changed_word(spark, sf):
    rng = random.Random(2)
    rows = []
    for i in range(0, 100, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(_edited(rng, base, 1)))]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 100, 2))


@pytest.mark.parametrize("tile", [7, 500])
def test_crowded_bands_in_tiles(spark, tile, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(_edited(rng, base, 2))) for i in range(60)]
    f = minhash.near_pairs
    monkeypatch.setattr(minhash, "near_pairs", lambda *a: f(*a, tile=tile))
    assert {r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, " \n"), (3, "Two words"), (4, "two  WORDS"), (5, text), (None, text), (5, text + " more"), (6, "x " * 60000), (None, "alone at last")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.component) for r in got))) == sorted(map(str, [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, 5), (5, 5), (6, 6), (None, None)]))
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
