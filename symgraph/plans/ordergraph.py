"""The order tables as a typed graph: nodes named kind:key, edges from child to parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.tables import table


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, name, kind, module)."""
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("rn"))
    parts = [
        t("region").select(_id("region", "r_regionkey").alias("node"), F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(None).cast("string").alias("module")),
        t("nation").join(region, F.col("n_regionkey") == F.col("rk")).select(_id("nation", "n_nationkey"), "n_name", F.lit("nation"), "rn"),
        t("customer").select(_id("customer", "c_custkey"), "c_name", F.lit("customer"), "c_mktsegment"),
        t("supplier").select(_id("supplier", "s_suppkey"), "s_name", F.lit("supplier"), F.lit(None).cast("string")),
        t("part").select(_id("part", "p_partkey"), "p_name", F.lit("part"), "p_brand"),
        t("orders").select(_id("order", "o_orderkey"), F.concat(F.lit("order#"), F.col("o_orderkey").cast("string")), F.lit("order"), "o_orderpriority"),
    ]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, kind), each once."""
    t = lambda n: table(spark, sf_dir, n)

    def link(df: DataFrame, source, target, kind: str) -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"))

    parts = [
        link(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "in"),
        link(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "in"),
        link(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "in"),
        link(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "placed_by"),
        link(t("lineitem").select("l_orderkey", "l_partkey").distinct(), _id("order", "l_orderkey"), _id("part", "l_partkey"), "contains"),
        link(t("lineitem").select("l_partkey", "l_suppkey").distinct(), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "supplied_by"),
    ]
    return reduce(DataFrame.union, parts)


NODES_SQL = """
    tn AS (
        SELECT concat('region:', r_regionkey) AS node, r_name AS name, 'region' AS kind, CAST(NULL AS VARCHAR) AS module FROM region
        UNION ALL SELECT concat('nation:', n_nationkey), n_name, 'nation', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('customer:', c_custkey), c_name, 'customer', c_mktsegment FROM customer
        UNION ALL SELECT concat('supplier:', s_suppkey), s_name, 'supplier', NULL FROM supplier
        UNION ALL SELECT concat('part:', p_partkey), p_name, 'part', p_brand FROM part
        UNION ALL SELECT concat('order:', o_orderkey), concat('order#', o_orderkey), 'order', o_orderpriority FROM orders)"""

EDGES_SQL = """
    te AS (
        SELECT concat('nation:', n_nationkey) AS source_id, concat('region:', n_regionkey) AS target_id, 'in' AS kind FROM nation
        UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'in' FROM customer
        UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'in' FROM supplier
        UNION ALL SELECT concat('order:', o_orderkey), concat('customer:', o_custkey), 'placed_by' FROM orders
        UNION ALL SELECT DISTINCT concat('order:', l_orderkey), concat('part:', l_partkey), 'contains' FROM lineitem
        UNION ALL SELECT DISTINCT concat('part:', l_partkey), concat('supplier:', l_suppkey), 'supplied_by' FROM lineitem)"""


def reach_sql(seed: str, depth: int, reverse: bool, kinds: tuple[str, ...] = ()) -> str:
    """(node, depth, edge_kind) as bfs() gives it, by a recursive union over (node, depth)."""
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    only = f"AND kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    return f"""
    WITH RECURSIVE {EDGES_SQL},
    walk(node, depth) AS (
        SELECT * FROM ({seed}) UNION
        SELECT e.{there}, w.depth + 1 FROM walk w JOIN te e ON e.{here} = w.node WHERE w.depth < {depth} {only}),
    first AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
    SELECT f.node, f.depth, min(e.kind) AS edge_kind
    FROM first f JOIN te e ON e.{there} = f.node {only} JOIN first g ON e.{here} = g.node AND g.depth = f.depth - 1
    WHERE f.depth > 0 GROUP BY f.node, f.depth"""


#: The order in which a walk follows the edges of this graph.
FOLLOWED = ("kind", "source_id", "target_id")


def visit_sql(seed: str, depth: int, reverse: bool, kinds: tuple[str, ...] = ()) -> str:
    """(node, depth, edge_kind, parent, visit_ord) as visits() gives it: one pair of steps for each level."""
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    only = f"AND e.kind IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    steps, parts = [f"l0 AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rank FROM ({seed}))"], []
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        order = "rank, kind, source_id, target_id"
        steps.append(f"v{k} AS (SELECT e.{there} AS node, w.rank, e.kind, e.source_id, e.target_id, w.node AS parent FROM l{k - 1} w JOIN te e ON e.{here} = w.node {only} WHERE e.{there} NOT IN ({seen}))")
        steps.append(f"l{k} AS (SELECT node, row_number() OVER (ORDER BY {order}) - 1 AS rank, kind, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS n FROM v{k}) WHERE n = 1)")
        ahead = " + ".join(["0", *(f"(SELECT count(*) FROM l{i})" for i in range(1, k))])
        parts.append(f"SELECT node, {k} AS depth, kind AS edge_kind, parent, rank + {ahead} AS visit_ord FROM l{k}")
    return f"WITH {EDGES_SQL}, {', '.join(steps)} {' UNION ALL '.join(parts)}"
