"""Exact duplicates by deterministic block naming (DataFrame functions only).

Each text, white space of ASCII left out, is cut into blocks of BLOCK bytes. Equal blocks get
one integer name by sorting; then neighbouring names are paired, and the pairs named in the same
way, until each text has one name. Two texts have the same name after the same number of
rounds exactly when they are equal: no digest decides anything.

A block or pair that stands in one place only makes its text unlike all others, so only
values with more places are named and only texts made of such alone go on. Each round halves
what is left of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.naming import sorted_names
from symgraph.storage import materialize

BLOCK = 1024
#: Fixed value: what two equal texts may differ in.
BLANK = r"[\x20\x09-\x0D]+"


def _pairs(names: Column, size: Column) -> Column:
    """Neighbours two by two; the last of an odd number is paired with -1, which no name is."""
    at = F.sequence(F.lit(0), F.floor((size - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.get(names, 2 * i).alias("left"), F.coalesce(F.get(names, 2 * i + 1), F.lit(-1)).alias("right")))


def _in_several_places(blocks: DataFrame) -> DataFrame:
    """Blocks without most of those that stand in one place only: their hash, which decides nothing else, stands in one too."""
    h = F.xxhash64("block").alias("h")
    repeated = materialize(blocks.groupBy(h).agg(F.count("*").alias("n")).where("n > 1").select("h"), "hashes")
    # Blocks meet their hashes by a shuffle at every size: hashes grow with the input.
    held = blocks.select("row", "size", "i", "block", h).join(repeated.hint("merge"), "h", "left_semi")
    return materialize(held.drop("h"), "repeated", "zstd")


def identities(blocks: DataFrame) -> DataFrame:
    """(row, round, name) of rows whose text another row has too; blocks is a written table (row, size, i, block)."""
    entries, keys, found = _in_several_places(blocks.select("row", "size", "i", "block")), ["block"], []
    while True:
        names = sorted_names(entries, keys, least=2)
        held = entries.join(names, keys).groupBy("row", "size").agg(F.sort_array(F.collect_list(F.struct("i", "name")))["name"].alias("names"))
        whole = materialize(held.where(F.size("names") == F.col("size")), "named")
        found.append(whole.where("size = 1").select("row", F.lit(len(found)).alias("round"), F.col("names")[0].alias("name")))
        longer = whole.where("size > 1")
        if not longer.limit(1).count():
            return reduce(DataFrame.union, found)
        halved = F.floor((F.col("size") + 1) / 2).cast("int")
        entries = materialize(longer.select("row", halved.alias("size"), F.inline(_pairs(F.col("names"), F.col("size")))), "pairs")
        keys = ["left", "right"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when they are after white space of ASCII is left out; null counts as empty, and
    empty ones are equal. Of equal texts the row with the most code points stays, then the one
    with the smallest id, a null id last, then any one of rows alike in both. Rows that repeat an
    id are rows of their own. A text of any length is cut up whole; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("points"), F.regexp_replace(text, BLANK, "").alias("plain"))
    rows = rows.select("id", "points", F.sha2(F.col("plain").cast("binary"), 256).alias("sha"), F.col("plain").cast("binary").alias("plain"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("size", F.greatest(F.lit(1), F.ceil(F.octet_length("plain") / block)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.substring(F.col("plain"), i * block + 1, F.lit(block)))
    cut = rows.select("row", "size", "id", "points", "sha", F.posexplode(cut).alias("i", "block"))
    first = F.col("i") == 0  # what belongs to the row stands beside its first block alone
    blocks = materialize(cut.select("row", "size", "i", "block", *[F.when(first, F.col(c)).alias(c) for c in ("id", "points", "sha")]), "blocks", "zstd")

    heads = blocks.where("i = 0").select("row", "id", "points", "sha")
    placed = materialize(heads.join(identities(blocks), "row", "left"), "placed")
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("last"), "id", "row"))
    groups = placed.where("name is not null").groupBy("round", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = materialize(groups.select("round", "name", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    alone = placed.where("name is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    shared = placed.join(groups, ["round", "name"]).select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
    return alone.union(shared).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
