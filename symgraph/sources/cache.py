"""Fetched documents as a table with ages, and which source of a document to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds a stored document lives, and the length that each source must be longer than, in the order tried:
# when documents are asked for, and when a URL was supplied.
TTL_SECONDS = 7 * 86400
LEAST_SUPPLIED = 500
ENSURE_ORDER = {"llms": 1000, "readme": 500, "supplied": 500}
SUPPLY_ORDER = {"supplied": 500, "llms": 500, "readme": 500}


def read_live(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries(framework, version, section, content, fetched_at) that have not run out."""
    return cache.where(now - F.col("fetched_at") < ttl)


def write_entries(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries in place of those of the same key."""
    keys = ["framework", "version", "section"]
    return cache.join(entries.select(*keys), keys, "left_anti").unionByName(entries)


def invalidate(cache: DataFrame, framework: str) -> DataFrame:
    return cache.where(F.col("framework") != framework)


def best_source(candidates: DataFrame, order: dict[str, int] = ENSURE_ORDER) -> DataFrame:
    """Of candidates(framework, version, source, content) the first source by order that is long enough."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    least = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("source")]
    return candidates.where(F.length("content") > least).groupBy("framework", "version").agg(F.min_by(F.struct("source", "content"), rank).alias("b")).select("framework", "version", "b.source", "b.content")


def store_entries(entries: DataFrame, path: str) -> None:
    """Write entries to a folder by framework and version: only the versions that entries name are replaced."""
    entries.write.partitionBy("framework", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
