"""Framework detection results: versions matched to documentation ranges, deduplication, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_versions(found: DataFrame, ranges: DataFrame, key: str = "key", major: str = "major") -> DataFrame:
    """found with the range that covers its major version.

    ranges(key, ord, min_major, max_major, ...): lower bound 0 and upper bound none where
    null, the upper one exclusive. Ranges are tried from the last to the first; where none
    covers the version, or it is unknown, the last one stands. Ranges are a fixed list of a
    few dozen, so each key's are one array, and no row of found moves.
    """
    rest = [c for c in ranges.columns if c != key]
    lists = ranges.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in rest if c != "ord"]))).alias("__r"))
    joined = found.join(F.broadcast(lists), F.col(key) == F.col("__key"), "left")
    version = F.col(major)
    fits = F.filter("__r", lambda r: (F.coalesce(r["min_major"], F.lit(0)) <= version) & (r["max_major"].isNull() | (version < r["max_major"])))
    picked = F.coalesce(F.get(fits, F.size(fits) - 1), F.get(F.col("__r"), F.size("__r") - 1))
    return joined.withColumn("__p", picked).select(*found.columns, *[F.col(f"__p.{c}").alias(c) for c in rest])


def prefer_versioned(found: DataFrame, keys: list[str], version: str, ord_col: str) -> DataFrame:
    """The first detection of each key, or the first with a version if the first has none."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).isNull(), ord_col)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def most_frequent_first_seen(rows: DataFrame, keys: list[str], value: str, ord_col: str) -> DataFrame:
    """(keys, value) with the most rows; ties go to the one seen first."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("__c"), F.min(ord_col).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__c"), "__first")
    return counted.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, value)


def category_summary(rows: DataFrame, category: str, label: Column, known: list[str]) -> DataFrame:
    """(category, items): distinct labels by category in label order, unknown categories under other."""
    bucket = F.when(F.col(category).isin(known), F.col(category)).otherwise("other")
    return rows.groupBy(bucket.alias("category")).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("items"))


def is_internal(value: Column, prefixes: list[str], pattern: str | None = None) -> Column:
    """Starts with a listed prefix or matches the pattern; values over 500 or patterns over 200 characters never do."""
    listed = F.exists(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: F.startswith(value, p))
    custom = value.rlike(pattern) if pattern and len(pattern) <= 200 and _compiles(pattern) else F.lit(False)
    return (F.length(value) <= 500) & (listed | custom)


def _compiles(pattern: str) -> bool:
    import re

    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def source_paths(deps: DataFrame, dirs: DataFrame) -> DataFrame:
    """deps(artifact) with the directory named like the artifact's last part, dashes kept or left out."""
    name = F.element_at(F.split("artifact", ":"), -1)
    by = dirs.groupBy("name").agg(F.min_by("path", "ord").alias("path"))
    first = by.select(F.col("name").alias("n1"), F.col("path").alias("p1"))
    second = by.select(F.col("name").alias("n2"), F.col("path").alias("p2"))
    return deps.withColumn("__a", name).join(first, F.col("__a") == F.col("n1"), "left").join(second, F.regexp_replace("__a", "-", "") == F.col("n2"), "left").withColumn("source_path", F.coalesce("p1", "p2")).drop("__a", "n1", "p1", "n2", "p2")
