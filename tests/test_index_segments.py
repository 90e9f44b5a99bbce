"""The index in segments: equal to one made anew after any changes, and sparing in what it reads."""

import random

from pyspark.sql import functions as F

from symgraph.operators import search as S
from symgraph.operators.index import SEGMENTS, Index

QUERIES = ["ab", "ab OR c", "a_b", "a b OR d", "a_b_c OR d_d", "none OR ab", "none", "OR", "d"]
COLS = ["title", "body"]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, b) for i, (t, b) in sorted(rows.items())], "id long, title string, body string")


def _same(index, rows, spark, limit, kept=None, queries=QUERIES):
    docs = _docs(spark, rows)
    for q in queries:
        where = F.col("id") > kept if kept is not None else None
        want = S.search(docs, q, "id", COLS, where, limit).collect()
        got = index.search(q, limit, docs.where(where).select("id") if where is not None else None).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), (q, limit)


def test_changes_leave_what_an_index_made_anew_has(spark):
    rng = random.Random(2)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(["a", "b", "ab", "c", "Ä", "d"]) for _ in range(rng.randint(0, 12)))
    rows = {i: (text(), text()) for i in range(60)}
    index = Index.build(_docs(spark, rows), "id", COLS)
    _same(index, rows, spark, 5)
    for turn in range(2):
        changed = {i: rows[i] for i in rng.sample(sorted(rows), 9)}
        index.remove(_docs(spark, changed))
        for i in changed:
            rows.pop(i)
        fresh = {i: (text(), text()) for i in [*list(changed)[:5], *range(100 + 4 * turn, 104 + 4 * turn)]}
        rows |= fresh
        index.add(_docs(spark, fresh))
    assert index.segments == 3
    _same(index, rows, spark, 3, queries=["ab OR c", "a_b"])
    _same(index, rows, spark, None, kept=20, queries=["ab OR c", "a b OR d"])
    again = Index.opened(spark, "id", COLS, index.tables)
    _same(again, rows, spark, 4, kept=10, queries=["ab OR c"])
    index._merge()
    assert index.segments == 1 and "removed" not in index.tables
    _same(index, rows, spark, 5, queries=["ab OR c", "a_b_c OR d_d"])


def test_many_segments_become_one(spark):
    index = Index.build(_docs(spark, {0: ("a b", "c")}), "id", COLS)
    for i in range(1, SEGMENTS + 1):
        index.add(_docs(spark, {i: ("a", "b " * i)}))
    assert index.segments == 1
    _same(index, {0: ("a b", "c"), **{i: ("a", "b " * i) for i in range(1, SEGMENTS + 1)}}, spark, 3, queries=["b OR c"])
    assert Index.build(_docs(spark, {}), "id", COLS).search("a").collect() == []


def test_a_search_reads_the_blocks_that_can_reach_its_score(spark):
    """Twice the documents: the same top is found, and what is read does not double."""
    read = []
    for n in (20_000, 40_000):
        # Two in five documents hold the word, most of them once among many others; some hold it often.
        often = F.when(F.col("id") % 5 > 1, F.lit("")).when(F.col("id") % 995 == 0, F.repeat(F.lit("word "), 5)).otherwise(F.lit("word "))
        docs = spark.range(n).select("id", F.lit("t").alias("title"), F.concat(often, F.repeat(F.lit("filler "), (F.col("id") % 50 + 10).cast("int"))).alias("body"))
        index = Index.build(docs, "id", COLS)
        got = [(r.id, r.rank) for r in index.search("word OR absent", 10).collect()]
        assert got == [(r.id, r.rank) for r in S.search(docs, "word OR absent", "id", COLS, None, 10).orderBy("rank", "id").collect()]
        assert index.read["postings"] == n * 2 / 5 and index.read["second"] < n / 100
        read.append(index.read["second"])
    assert read[1] <= 2 * read[0]
