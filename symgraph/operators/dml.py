"""Store changes as set operations: who wins, what cascades, what went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.storage import materialize


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, keys: list[str], *seq: str) -> DataFrame:
    """Insert or ignore: the earliest write of a key stays, metadata included; each further column of seq settles the ties of those before it."""
    return keep_one(rows, keys, [F.col(c).asc() for c in seq])


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert: the latest write of a key stays."""
    return keep_one(rows, keys, [F.col(seq).desc()])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """incoming replaces stored rows of equal keys but keeps their ids; new keys get ids past the largest.

    Ids of new rows are dense by key order within the incoming rows only. They are counted
    by ranges of keys: each range is a partition, ranges' totals are summed (one row for
    each), and a window numbers the rows inside one. Equal keys among incoming are taken
    as one row's and fall into one range.
    """
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    old = stored.select(*keys, F.col(id_col).alias("__old"))
    joined = materialize(incoming.drop(id_col).join(old, keys, "left"), "upsert")
    known = joined.where("__old is not null").withColumn(id_col, F.col("__old")).drop("__old")
    fresh = joined.where("__old is null").drop("__old")
    ranged = materialize(fresh.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "upsert-ranges")
    totals = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = totals.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    fresh = ranged.join(F.broadcast(ahead), "__range").join(F.broadcast(top)).withColumn(id_col, F.col("__top") + F.col("__before") + place)
    kept = stored.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(stored.columns).union(known.select(stored.columns)).union(fresh.select(stored.columns))


def delete_files(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Remove doomed(file_id) and all that hangs on it: nodes, their side rows, edges at either end."""
    out = dict(tables)
    nodes = tables["nodes"].join(doomed, "file_id", "left_semi").select(F.col("id").alias("node_id"))
    for name, df in tables.items():
        if name == "edges":
            out[name] = df.join(nodes, df.source_id == nodes.node_id, "left_anti").join(nodes, df.target_id == nodes.node_id, "left_anti")
        elif "file_id" in df.columns:
            out[name] = df.join(doomed, "file_id", "left_anti")
        elif "node_id" in df.columns:
            out[name] = df.join(nodes, "node_id", "left_anti")
    return out


def delete_edges_by_kind(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(~F.col("kind").isin(kinds)) if kinds else edges


def stale_files(stored: DataFrame, current: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(path, status) of stored rows whose content changed or is gone."""
    now = current.select(key, F.col(digest).alias("__now"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "deleted").when(~F.col(digest).eqNullSafe(F.col("__now")), "changed")
    return stored.join(now, key, "left").select(key, status.alias("status")).where("status is not null")


def stale_counts(stale: DataFrame) -> DataFrame:
    """One row (changed, deleted) of what stale_files found."""
    return stale.agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "deleted").alias("deleted"))


def unseen(current: DataFrame, stored: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """Rows of current that are new or changed: what an incremental scan takes up."""
    return current.join(stored.select(key, digest), [key, digest], "left_anti")


def unique_or_none(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are alone with their key."""
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def live_entries(entries: DataFrame, now: Column, ttl: int, at: str) -> DataFrame:
    """Cache entries younger than ttl."""
    return entries.where(now - F.col(at) < ttl)


def newest_entries(entries: DataFrame, most: int, at: str, tie: str) -> DataFrame:
    """What a pruned cache keeps."""
    return entries.orderBy(F.desc(at), tie).limit(most)


def pruned_cache(entries: DataFrame, now: Column, ttl: int, most: int, at: str, tie: str) -> DataFrame:
    """All entries while there are at most `most`; beyond that expired ones go, then the oldest."""
    total = entries.agg((F.count("*") > most).alias("__full"))  # one row
    left = entries.join(F.broadcast(total)).where(~F.col("__full") | (now - F.col(at) < ttl)).drop("__full")
    return newest_entries(left, most, at, tie)
