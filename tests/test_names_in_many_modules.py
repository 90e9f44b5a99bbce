"""A name that stands in very many modules is looked up, not paired."""

import time

from pyspark.sql import functions as F

from symgraph.operators import resolve


def test_one_name_in_as_many_modules_as_call_sites(spark):
    n = 80_000
    ids = spark.range(n)
    module = F.concat(F.lit("m"), F.col("id"))
    base = ids.select("id", module.alias("module"), F.lit("handler").alias("name"), F.lit("method").alias("kind"), F.lit(None).cast("long").alias("parent_id"))
    extra = F.lit(None).cast("string").alias("extends_name"), F.lit(None).cast("array<string>").alias("implements_names")
    nodes = base.select("*", *extra).union(ids.select((F.col("id") + n).alias("id"), module, F.concat(F.lit("User"), F.col("id")), F.lit("class"), F.lit(None), F.lit("handler"), F.array(F.lit("handler"))))
    sites = ids.select((F.col("id") + n).alias("node_id"), F.lit(0).alias("ord"), F.lit("handler").alias("target"), F.lit(None).cast("string").alias("receiver"))
    began = time.time()
    made = resolve.calls({"nodes": nodes, "call_sites": sites})
    assert made.count() == n and made.where("source_id - target_id = 80000").count() == n
    heirs = resolve.inheritance({"nodes": nodes})
    assert heirs.where("source_id - target_id = 80000").groupBy("kind").count().orderBy("kind").collect() == [("extends", n), ("implements", n)]
    assert time.time() - began < 120  # pairs would be 6.4 thousand million rows


def test_the_class_of_the_callers_module_goes_first(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "Store", "class", None), (2, "a", "put", "method", 1), (3, "b", "store", "class", None), (4, "b", "put", "method", 3), (5, None, "AppStore", "class", None), (6, None, "put", "method", 5),
         (7, "b", "run", "method", None), (8, "c", "run", "method", None), (9, None, "run", "method", None)],
        "id long, module string, name string, kind string, parent_id long",
    )
    sites = spark.createDataFrame([(7, 0, "put", "store"), (8, 0, "put", "store"), (9, 0, "put", "store"), (1, 1, "put", "store"), (7, 1, "run", "other"), (8, 1, "none", "store"), (8, 2, "run", "")], "node_id long, ord int, target string, receiver string")
    got = {(r.source_id, r.seq): (r.target_id, r.metadata) for r in resolve.calls({"nodes": nodes, "call_sites": sites}).collect()}
    assert got == {(7, 0): (4, "store"), (8, 0): (4, "store"), (9, 0): (4, "store"), (1, 1): (2, "store"), (7, 1): (7, "other"), (8, 2): (8, None)}
