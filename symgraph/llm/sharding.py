"""Contiguous shards of equal byte size from global prefix sums (DataFrame functions only).

Rows are put in one global order: a slice of the text's hash, then the texts of that slice
by hash. A text with far more rows than an even slice follows the rest of its slice on
its own, its rows dealt over parts by a salt. So equal texts are neighbours always, and
only a cut between two shards parts them. Per-part totals are summed first, their running
sums give every part its offset, and a window inside each part finishes the sum, so that
no task ever orders more than one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.storage import materialize

#: Slices of the hash; the table of part totals has at most twice as many rows.
SLICES = 4096


def _size(text: Column, overhead: int) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, slices: int = SLICES) -> DataFrame:
    """Assign every row to a shard; sizes differ from the target by less than one row.

    Equal texts follow each other, in one shard unless a cut runs through them. Returns id, size, text_crc32, shard and slot (gapless from 0 within the shard).
    A null text counts as empty; null ids sort first; repeated rows each get a slot
    of their own; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        _size(text, overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
    )
    rows = materialize(rows.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")), "shard-sizes")

    # A text with more than twice an even slice's rows is hot; there are at most slices / 2 of them,
    # and their salts sum to slices / 2 more parts at most.
    total_rows = rows.agg(F.greatest(F.lit(1.0), 2.0 * F.count("*") / F.lit(slices)).alias("most"))
    hot = rows.groupBy(F.coalesce("h", F.lit(0)).alias("hot")).agg(F.count("*").alias("n")).join(F.broadcast(total_rows)).where("n > most")
    hot = hot.select("hot", F.ceil(F.col("n") / F.col("most")).alias("salts"))
    placed = rows.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").withColumn("part", F.struct("slice", F.col("hot"), F.pmod(F.xxhash64("id", "crc"), F.coalesce("salts", F.lit(1))).alias("salt")))

    # At most 2 * slices totals: safe to broadcast and to order in one task.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_before"),
    )
    grand = totals.agg(F.sum("part_bytes").alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy("h", "id", "crc", "size")
    cut = (
        placed.join(F.broadcast(offsets.withColumnRenamed("part", "p")), F.col("part").eqNullSafe(F.col("p")))
        .join(F.broadcast(grand))
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("position", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("start").cast("decimal(30,0)") * 2 + F.col("size")) * shards / (2 * F.col("all_bytes")))).cast("int"))
    )
    cut = materialize(cut.select("id", "size", "crc", "shard", "position"), "shard-cuts")
    firsts = cut.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("position") - F.col("first")).alias("slot")
    )
