"""SimHash fingerprints, and near pairs by a Gray-ordered hierarchical index.

Cut into p segments, fingerprints that differ in at most k bits agree on p - k of them, so
each distinct fingerprint goes to the cell of every choice of p - k segments; a cell's
members share that masked bit pattern, the top node of an index of its own. Inside,
members are sorted by Gray rank, every run of neighbours is a node holding the bits that
all of them share (the mask) and their values (the pattern), and runs of runs are nodes
above. A search adds up the differences on the bits that each node settles anew and drops
the node with everything below it once they exceed k.

One Gray order over all fingerprints would need no copies, but its upper nodes settle only
the leading bits: among a million groups (20 bits) a query for k = 4 must visit the
sum of C(20, 0..4), 6,196, of them, each in some other task. The cells are upper nodes on
which a pair agrees outright, so that a query visits one group for each. More
fingerprints get more segments: p = k + 1 while that leaves cells of some CELL members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.components import connected_components, local_forest
from symgraph.storage import materialize

FANOUT = 8
#: Members of a cell, on average, from which segments are cut finer.
CELL = 1000
#: Pairs (query, node) that a search holds at once.
FRONTIER = 400_000


def shingle_hashes(text: str | None, words: int, hasher) -> np.ndarray:
    """Hash of each run of so many words; a shorter text is one run, a text without words has none."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: lowers A-Z and splits at \x20 \x09-\x0d only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([hasher(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((hasher(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(text: str | None, words: int, hasher) -> int:
    """64-bit SimHash over word shingles; signed, as Spark's long."""
    hashes = shingle_hashes(text, words, hasher)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): null and blank texts have fingerprint 0; a short text is one shingle."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        hasher = lambda data: xxh64_intdigest(data, seed)
        for batch in stream:
            fps = pa.array([fingerprint(t.as_py(), words, hasher) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Levels of nodes over codes in Gray order; level 0 holds the codes."""

    def __init__(self, codes: np.ndarray, shared: np.uint64):
        """shared: the bits on which all members are known to agree (the root's mask)."""
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        every = ~np.uint64(0)
        levels = [(np.full(len(self.codes), every), self.codes)]
        while len(levels[-1][0]) > 1:
            mask, pattern = levels[-1]
            cuts = np.arange(0, len(mask), FANOUT)
            ones = np.bitwise_and.reduceat(pattern, cuts)
            some = np.bitwise_or.reduceat(pattern, cuts)
            agreed = np.bitwise_and.reduceat(mask, cuts) & ~(ones ^ some)
            levels.append((agreed, ones & agreed))
        self.levels = levels
        self.shared = shared

    def search(self, queries: np.ndarray, most: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (query, code) of pairs that differ in at most `most` bits."""
        step = max(1, frontier // (FANOUT * 16))
        for lo in range(0, len(queries), step):
            q = np.arange(lo, min(lo + step, len(queries)))
            yield from self._down(queries, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.shared), len(self.levels) - 1, most, frontier)

    def _down(self, queries, q, node, spent, settled, level, most, frontier):
        mask, pattern = self.levels[level]
        fresh = mask[node] & ~settled
        spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & fresh)
        alive = spent <= most
        q, node, spent, settled = q[alive], node[alive], spent[alive], (settled | mask[node])[alive]
        if level == 0:
            if len(q):
                yield q, node
            return
        below = len(self.levels[level - 1][0])
        for lo in range(0, len(q), frontier // FANOUT):
            part = slice(lo, lo + frontier // FANOUT)
            kids = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
            real = kids < below
            yield from self._down(queries, np.repeat(q[part], FANOUT)[real], kids[real], np.repeat(spent[part], FANOUT)[real], np.repeat(settled[part], FANOUT)[real], level - 1, most, frontier)


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of a 64-bit word."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def top_masks(n: int, most: int, parts: int | None = None) -> list[int]:
    """The masks of the cells for n fingerprints: every choice of parts - most segments, some pair of which always agrees."""
    if parts is None:
        parts = most + 1
        while n >> min(64 * (parts - most) // parts, 62) > CELL and parts < most + 4:
            parts += 1
    spans = [((1 << w) - 1) << a for a, w in _segments(parts)]
    return [sum(chosen) for chosen in combinations(spans, parts - most)]


def near_pairs(distinct: DataFrame, most: int = 4, tile: int = 1000, parts: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join all that differ in at most `most` bits.

    Inside a cell links come as a spanning forest, so a dense cell gives no more rows
    than members. A cell of more than `tile` members is cut into tiles by hash; every
    pair of tiles is searched on its own, so no task holds more than two tiles.
    """
    masks = top_masks(distinct.count(), most, parts)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for i, m in enumerate(signed)])
    members = distinct.select("fp", F.explode(cells).alias("cell"))
    sizes = members.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > tile).select(F.col("cell").alias("c"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    placed = members.join(crowded, F.col("cell") == F.col("c"), "left").drop("c").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    grids = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    dealt = placed.select("fp", "cell", own.alias("own"), F.explode(grids).alias("grid"))
    keyed = dealt.select("fp", F.xxhash64("cell", "grid").alias("task"), F.col("cell.seg").alias("seg"), F.col("cell.val").alias("val"), (F.col("own") == F.col("grid.j")).alias("right"), (F.col("grid.i") == F.col("grid.j")).alias("same"))

    shared = [np.uint64(m) for m in masks]

    def search(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        seg, val = table.column("seg").to_numpy(), table.column("val").to_numpy()
        right = table.column("right").to_numpy(zero_copy_only=False)
        same = table.column("same").to_numpy(zero_copy_only=False)
        xs, ys = [], []
        order = np.lexsort((val, seg))
        cuts = np.flatnonzero(np.concatenate([[True], (seg[order][1:] != seg[order][:-1]) | (val[order][1:] != val[order][:-1]), [True]]))
        for lo, hi in zip(cuts, cuts[1:]):  # one cell, save for a clash of the task's hash
            at = order[lo:hi]
            queries = fp[at] if same[at[0]] else fp[at][~right[at]]
            codes = fp[at] if same[at[0]] else fp[at][right[at]]
            if not len(queries) or not len(codes):
                continue
            index = GrayIndex(codes, shared[seg[at[0]]])
            for q, c in index.search(queries, most):
                x, y = queries[q], index.codes[c]
                keep = x != y
                xs.append(x[keep].view(np.int64))
                ys.append(y[keep].view(np.int64))
                if sum(map(len, xs)) > 4 * FRONTIER:
                    f, r = local_forest(np.concatenate(xs), np.concatenate(ys))
                    xs, ys = [f], [r]
        if not xs:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        f, r = local_forest(np.concatenate(xs), np.concatenate(ys))
        return pa.table({"a": pa.array(f, pa.int64()), "b": pa.array(r, pa.int64())})

    return by_task(keyed, search)


def by_task(keyed: DataFrame, search) -> DataFrame:
    """Run search once for each value of task."""
    # Cells of a few members come by the ten thousand, so one call takes a whole partition's.
    ordered = keyed.repartition("task").sortWithinPartitions("task")

    def batches(stream):
        held: list[pa.RecordBatch] = []

        def flush(upto):
            table = pa.Table.from_batches(held)
            done, rest = table.slice(0, upto), table.slice(upto)
            return done, rest.combine_chunks().to_batches() if rest.num_rows else []

        for batch in stream:
            held.append(batch)
            table = pa.Table.from_batches(held)
            tasks = table.column("task").to_numpy()
            last = int(np.searchsorted(tasks, tasks[-1]))  # the last task may go on in the next batch
            if last:
                done, held = flush(last)
                yield from _each(done, search)
        if held:
            yield from _each(pa.Table.from_batches(held), search)

    return ordered.mapInArrow(batches, "a long, b long")


def _each(table: pa.Table, search):
    tasks = table.column("task").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1], [True]]))
    outs = [search(table.slice(lo, hi - lo)) for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()) if hi - lo > 1]
    yield from pa.concat_tables([t for t in outs if t.num_rows] or [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})]).combine_chunks().to_batches()


def near_duplicates(docs: DataFrame, most: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most `most` bits.

    Texts without words share fingerprint 0 and link like any other. Rows with a null id
    take part; a component takes its name from its smallest id that is not null, and is
    null where there is none. Rows that repeat an id are kept as they come. An empty table
    gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first"))
    distinct = materialize(distinct, "distinct-fingerprints")
    links = near_pairs(distinct.select("fp"), most)
    joined = connected_components(links)
    homes = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    names = homes.groupBy("root").agg(F.min("first").alias("component"))
    named = materialize(homes.join(names, "root").select(F.col("fp").alias("f"), "component"), "fingerprint-classes")
    return marked.join(named, marked.fp == named.f).select(F.col("id").alias(id_col), "fp", "component")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


__all__ = ["fingerprints", "near_pairs", "near_duplicates", "hex_digits", "GrayIndex", "gray_rank", "shingle_hashes", "by_task"]
