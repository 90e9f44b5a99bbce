"""What an index costs on disk: its own tables, without a copy of the postings beside them or in shuffle files."""

import os
from urllib.parse import urlparse

from symgraph.operators import index
from symgraph.plans import catalog
from symgraph.storage import shared_root

ROWS = [(1, "b a b", "A ä"), (2, None, None), (3, "", "c"), (4, "x " * 300 + "y", None), (5, "—", "…")]


def _docs(spark):
    return spark.createDataFrame(ROWS, "id long, title string, body string")


def test_words_of_a_document_are_gathered_in_its_row(spark):
    terms = index._terms(_docs(spark), "id", ["title", "body"])
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.term): (r.dl, r.places) for r in terms.collect()}
    second = index.COLUMN
    assert got == {(1, "a"): (5, [1, second, second + 1]), (1, "b"): (5, [0, 2]), (3, "c"): (1, [second]), (4, "x"): (301, list(range(300))), (4, "y"): (301, [300])}


def test_building_leaves_the_tables_of_the_index_alone(spark):
    root = urlparse(shared_root(spark)).path
    before = set(os.listdir(root))
    built = index.Index.build(_docs(spark), "id", ["title", "body"])
    assert sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before) == ["directory", "segment-0", "totals"]
    assert [tuple(r) for r in built.tables["totals"].collect()] == [(0, 5, 307)]
    assert sorted((r.term, r.n, r.tf, r.dl) for r in built.tables["directory"].collect()) == [("a", 1, 3, 5), ("b", 1, 2, 5), ("c", 1, 1, 1), ("x", 1, 300, 301), ("y", 1, 1, 301)]


def test_the_top_of_all_documents_leaves_the_index_alone(spark, sf):
    root = urlparse(shared_root(spark)).path
    before = set(os.listdir(root))
    assert catalog.QUERIES["search_blocks_top"](spark, sf).count() == 20
    assert sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before) == ["directory", "segment-0", "totals"]
