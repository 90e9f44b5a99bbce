"""Integer names of values in sorted order: equal values get one name, different ones different names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.storage import materialize


def sorted_names(values: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, name) for every combination of keys that stands in at least `least` rows, as a written table.

    Combinations are counted ahead of the shuffle, so one that fills a third of the rows is a
    few rows there; then they are sorted by ranges and numbered in order, with gaps. The table
    is written before it is used: a task that runs again cannot name anew what others have read.
    """
    kinds = values.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    ordered = kinds.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select(*keys, F.monotonically_increasing_id().alias("name")), "names")
