"""Prefix trie of conversations: ROLLUP over positional turn ids, block of columns by block.

Equal turns (role, text) get one integer id by sorting. A block of a conversation is a row of turn ids in
columns; one ROLLUP over these columns aggregates all its prefixes together, and grouping_id
gives their depth. A node is named by its depth and the smallest conversation through it. A
conversation that is longer goes on in the next block of columns, keyed by the node that the block
before ended in, so columns stay few however long it is.

What a node's subtree holds is summed over conversations, not over nodes: every node belongs to
its smallest conversation, which keeps all nodes from some depth on, so a second ROLLUP over the
same rows adds up the bytes and leaves that conversations own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.naming import sorted_names
from symgraph.storage import fresh_path, materialize

#: Columns of the first blocks; the last width is that of all further ones. A ROLLUP makes one row more than columns.
WIDTHS = (8, 16, 32)
#: Neighbouring conversation ids that are joined to one piece of a list.
PIECE = 4096


def named_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id, bytes) of every turn that belongs to a conversation.

    Null roles and texts are empty. Ids follow the order of (role, text). Turns without a conv_id belong to no
    conversation and are left out; other columns are ignored; an empty table gives none.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    ids = sorted_names(turns, ["role", "text"])
    named = turns.join(ids, ["role", "text"])
    return materialize(named.select("conv_id", "turn", F.col("name").alias("turn_id"), F.octet_length("text").cast("long").alias("bytes")), "turns")


def numbered(named: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, bytes): places from 1 by turn, null first; equal turns by (role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return named.select("conv_id", F.row_number().over(order).alias("pos"), "turn_id", "bytes")


def _columns(width: int) -> list[str]:
    return [f"t{j}" for j in range(1, width + 1)]


def _rolled(block: DataFrame, width: int, done: int, sums: list[str]) -> DataFrame:
    """(depth, conv_id, n_convs, prior, path, sums) of the prefixes of a block; depth `done` is left to the block before, but for the root."""
    cols = ", ".join(_columns(width))
    more = "".join(f", sum({c}) AS {c}" for c in sums)
    rows = block.sparkSession.sql(
        f"SELECT prior, {cols}, {width} - bit_count(grouping_id()) AS d, min(conv_id) AS conv_id, count(*) AS n_convs{more} FROM {{block}} GROUP BY prior, ROLLUP ({cols})", block=block
    )
    path = F.slice(F.array(*_columns(width)), F.lit(1), F.col("d"))
    real = F.when(F.col("d") == 0, F.lit(done == 0)).otherwise(F.get(F.array(*_columns(width)), F.col("d") - 1).isNotNull())
    return rows.where(real).select((F.col("d") + done).alias("depth"), "conv_id", "n_convs", "prior", path.alias("path"), *sums)


def _by_block(turns: DataFrame) -> DataFrame:
    """turns as a written table with block and slot (from 1), a folder for each block, so that a block's round reads its own turns alone."""
    starts = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
    at = F.col("pos") - 1 - starts[-1]
    block, slot = F.lit(len(WIDTHS) - 1) + F.floor(at / WIDTHS[-1]), at % WIDTHS[-1] + 1
    for k in reversed(range(len(WIDTHS) - 1)):
        block, slot = (F.when(F.col("pos") <= starts[k + 1], x).otherwise(y) for x, y in ((F.lit(k), block), (F.col("pos") - starts[k], slot)))
    rows = turns.withColumn("slot", slot.cast("int")).withColumn("block", block.cast("int"))
    path = fresh_path(turns.sparkSession, "sequences")
    turns.sparkSession.sql("SELECT /*+ REBALANCE(block) */ * FROM {rows}", rows=rows).write.partitionBy("block").parquet(path)
    return turns.sparkSession.read.schema(rows.schema).parquet(path)


def _blocks(turns: DataFrame, members: DataFrame) -> tuple[list[tuple[DataFrame, int, int]], DataFrame, DataFrame]:
    """(block rows, width, turns before) of each block; nodes (depth, conv_id, parent); ends (depth, node, conv_id).

    What a block gives is written, so that plans do not grow with the number of blocks.
    """
    longest = members.agg(F.max("size")).first()[0]
    going = members.select("conv_id", "size", F.lit(0).cast("long").alias("prior"))
    blocks, nodes, ends, done = [], [], [], 0
    while longest is not None and (done < longest or not blocks):
        width = WIDTHS[min(len(blocks), len(WIDTHS) - 1)]
        inside = turns.where(F.col("block") == len(blocks))
        spread = inside.groupBy("conv_id").agg(*[F.max(F.when(F.col("slot") == j, F.col("turn_id"))).alias(c) for j, c in enumerate(_columns(width), 1)])
        block = materialize(going.join(spread, "conv_id", "left"), "block")
        found = materialize(_rolled(block, width, done, []), "prefixes")
        up = found.select(F.col("prior").alias("p"), F.col("path").alias("up"), F.col("conv_id").alias("parent"))
        lower = found.where(F.col("depth") > done + 1)
        lower = lower.join(up, (lower["prior"] == up["p"]) & (F.slice("path", F.lit(1), F.size("path") - 1) == up["up"])).select("depth", "conv_id", "parent")
        first = found.where(F.col("depth") == done + 1)
        if done:
            upper = first.select("depth", "conv_id", F.col("prior").alias("parent"))
        else:  # the root is the one prefix without turns
            root = found.where("depth = 0").select("depth", "conv_id")
            upper = first.select("depth", "conv_id").join(F.broadcast(root.select(F.col("conv_id").alias("parent"))))
            upper = upper.union(root.select("depth", "conv_id", F.lit(None).cast("long")))
        nodes.append(materialize(upper.union(lower), "prefix-nodes"))
        held = F.least(F.col("size") - done, F.lit(width)).cast("int")
        full = block.select("conv_id", "size", F.col("prior").alias("b"), F.slice(F.array(*_columns(width)), F.lit(1), held).alias("all"))
        named = found.select(F.col("conv_id").alias("node"), "prior", "path")
        at = full.join(named, (F.col("b") == F.col("prior")) & (F.col("all") == F.col("path")))
        at = materialize(at.select("conv_id", "size", "node"), "reached")
        blocks.append((block, width, done))
        done += width
        ends.append(at.where(F.col("size") <= done).select(F.col("size").alias("depth"), "node", "conv_id"))
        going = at.where(F.col("size") > done).select("conv_id", "size", F.col("node").alias("prior"))
    return blocks, reduce(DataFrame.union, nodes), reduce(DataFrame.union, ends)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): the digest of each node's list of conversations that end there.

    Ids of one range make a piece, and pieces are digested one after the other as they come sorted,
    so that a node where very many end is never one string.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(piece.alias("ids"))
    ordered = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece").select("depth", "node", "ids")

    def digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, state = ["depth", "conv_id", "ends_sha256"], None, None
        types = [pa.int32(), pa.int64(), pa.string()]
        for batch in stream:
            out = []
            for depth, node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, node) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, state.hexdigest()), types)], names)

    return ordered.mapInArrow(digest, "depth int, conv_id long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one too.

    turns is (conv_id, pos, turn_id, bytes), places from 1 without gaps; convs has the conv_id of every
    conversation once, those without turns too. Returns conv_id (the smallest conversation through the node),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree: bytes of a node's last turn
    times the conversations through it less one) and ends_sha256. Equal conversations share all nodes;
    no conversations give no rows; a conversation takes one round for each block of its turns.
    """
    ahead = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("conv_id", F.col("pos").cast("int").alias("pos"), "turn_id", "bytes", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("before"))
    turns = _by_block(turns)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("size"), F.sum("bytes").alias("total"))
    members = convs.select("conv_id").join(lengths, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total", F.lit(0)).alias("total"))
    members = materialize(members, "members")
    if not members.limit(1).count():
        none = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return turns.sparkSession.createDataFrame([], none)
    blocks, nodes, ends = _blocks(turns, members)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"))
    before = turns.select(F.col("pos").alias("depth"), "conv_id", "before")
    nodes = materialize(nodes.join(children, ["depth", "conv_id"], "left").join(before, ["depth", "conv_id"], "left").fillna(0, ["n_children", "before"]), "nodes")

    # Nodes of a conversation that is the smallest through them begin at some depth and go on to its end.
    firsts = nodes.groupBy("conv_id").agg(F.min("before").alias("kept"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    shares = members.join(firsts, "conv_id", "left").select("conv_id", "total", (F.col("total") - F.coalesce("kept", "total")).alias("own"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    shares = materialize(shares, "shares")
    rolled = [_rolled(b.join(shares, "conv_id"), width, done, ["total", "own", "leaves"]).drop("prior", "path") for b, width, done in blocks]
    sums = reduce(DataFrame.union, [materialize(r, "sums") for r in rolled])
    sums = sums.withColumnsRenamed({"total": "all_total", "own": "all_own"})
    joined = nodes.join(sums, ["depth", "conv_id"]).join(shares.drop("leaves"), "conv_id").join(_digests(ends), ["depth", "conv_id"], "left")
    # Bytes from the node on, of all conversations less those of all distinct nodes.
    distinct = F.col("all_own") - F.col("own") + F.col("total") - F.col("before")
    return joined.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("all_total") - F.col("n_convs") * F.col("before") - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
