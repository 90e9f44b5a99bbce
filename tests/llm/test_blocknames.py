"""Block naming against grouping by whole texts, and against SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from symgraph.llm import blocknames, queries, sql


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for key, held in groups.items():
        keep = min(held, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        kept = iter([True])
        for i, t in held:
            mine = (i, t) == keep
            out.append((i, keep[0], len(held), mine and next(kept, False), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(str, out))


def made_up(rng):
    letters = ["a", "b", " ", "é", "\n", "🙂"]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(12)]
    out = []
    for i in range(300):
        t = rng.choice(base)
        if rng.random() < 0.3:
            t = t + rng.choice(base)
        if rng.random() < 0.2:
            t = t.replace(" ", rng.choice(["  ", "\t", ""]))
        out.append((i, t))
    return out


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_groups_equal_those_of_whole_texts(spark, block):
    rows = made_up(random.Random(block))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, name string")
    got = blocknames.exact_duplicates(docs, block=block).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)
    assert 20 < sum(r.kept for r in got) < 250


def test_hard_rows(spark):
    long = "0123456789" * 5000
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (None, "a b"), (9, "ab"), (9, "ab"), (9, "ab"), (4, long), (5, long + " "), (6, long + "x"), (7, "\x85a b"), (8, "\x85ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = blocknames.exact_duplicates(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)
    assert blocknames.exact_duplicates(docs.limit(0)).collect() == []


def test_names_of_one_round_never_meet_those_of_another(spark):
    """Names count anew in each round: a text of one block and one of two may bear the same number."""
    rows = [(1, "a"), (2, "a"), (3, "bb"), (4, "bb"), (5, "bbb"), (6, "bbb"), (7, "bbbb"), (8, "bbbb")]
    got = blocknames.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, i - (i + 1) % 2 if i % 2 == 0 else i, 2) for i in range(1, 9)]


def test_query_equals_sql(spark, sf):
    got = queries.op12_exact_dedup(spark, sf)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
        wanted = db.execute(sql.ORACLES["op12_exact_dedup"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert any(r[2] > 1 for r in wanted)
