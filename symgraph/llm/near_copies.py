"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, the sets themselves decide.

A text's set of shingles gets WORDS SimHash fingerprints, the bits of each from hashes of
their own. Two sets at a similarity of 0.8 differ in 15 % of the bits (19 % at worst, four
shingles of five), too many for any segment to be sure to agree in one fingerprint: 10 of
64. Over all fingerprints there are WORDS * PARTS segments, and some segment agrees with probability
0.9999 at 0.8 (0.999 at that worst) and more above. Texts that agree on one share a cell,
the top node of the Gray-ordered index that simhash builds, searched there for
fingerprints within MOST bits; with the next fingerprint BOTH may differ at most.

Candidates joined that way are a loose group. Each loose group is then compared by its
sets, so a set travels once, however many candidates it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.components import ROWS, contracted_components, local_forest
from symgraph.llm.minhash import _compare, _digest, shingle_set, shingle_sets
from symgraph.llm.simhash import GrayIndex, _segments, by_task
from symgraph.storage import files_for, materialize

WORDS, PARTS = 20, 5
#: Bits in which candidates differ at most: in the fingerprint of their cell, and in that and the next.
MOST, BOTH = 16, 31
#: Members of a cell from which it is cut into tiles.
TILE = 4000
#: Pairs of a query and a node that a search holds at once.
SEARCHED = 50_000
#: Sets, or their fingerprints, in one file; the tasks that search for them are as many at most.
SETS = 1000
#: Shingles whose bits are counted at once, in one byte each.
PIECE = 255

_RNG = np.random.default_rng(7)
_TIMES = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, WORDS, np.uint64)
_MIX, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_SPANS = _segments(PARTS)
#: Bits of a cell's number that hold a segment's value.
_WIDTH = max(w for _, w in _SPANS)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """WORDS SimHash fingerprints of a set of shingle hashes; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    total = np.zeros(WORDS * 64, np.int64)
    for lo in range(0, len(shingles), PIECE):
        h = shingles[lo : lo + PIECE, None] * _TIMES + _PLUS
        h ^= h >> _HALF
        h *= _MIX
        h ^= h >> _HALF
        bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits((total * 2 > len(shingles)).astype(np.uint8), bitorder="little").view("<u8")


def _cells(distinct: DataFrame) -> DataFrame:
    """(cell, digest, code, after): a row for each segment of each fingerprint; cell holds the segment's number and value."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for lo in range(0, batch.num_rows, 500):
                digest = batch.column(0).slice(lo, 500).to_numpy()
                held = batch.column(1).slice(lo, 500).to_pylist()
                words = np.frombuffer(b"".join(held), "<u8").reshape(-1, WORDS)
                digest = digest[[len(h) > 0 for h in held]]
                after = np.roll(words, -1, axis=1)
                values = np.stack([(words >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in _SPANS], axis=2).astype(np.int64)
                cells = (np.arange(WORDS * PARTS).reshape(WORDS, PARTS) << _WIDTH) + values
                columns = [cells.ravel().astype(np.int32), np.repeat(digest, WORDS * PARTS), np.repeat(words.ravel(), PARTS).view(np.int64), np.repeat(after.ravel(), PARTS).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "digest", "code", "after"])

    return distinct.select("digest", "words").mapInArrow(batches, "cell int, digest long, code long, after long")


def _forest(cell: int, digest: np.ndarray, code: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates between members at `left` and at `right` of a cell; where those are the same, each pair counts once."""
    same = left is right
    at, width = _SPANS[(cell >> _WIDTH) % PARTS]
    index = GrayIndex(code[right], np.uint64(((1 << width) - 1) << at))
    held, xs, ys, n = right[index.order], [], [], 0
    for q, c in index.search(code[left], MOST, SEARCHED):
        x, y = left[q], held[c]
        keep = np.bitwise_count(code[x] ^ code[y]) + np.bitwise_count(after[x] ^ after[y]) <= BOTH
        if same:
            keep &= x < y
        xs.append(digest[x[keep]])
        ys.append(digest[y[keep]])
        n += len(xs[-1])
        if n > SEARCHED:
            f, r = local_forest(np.concatenate(xs), np.concatenate(ys))
            xs, ys, n = [f], [r], 0
    if not any(map(len, xs)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_forest(np.concatenate(xs), np.concatenate(ys))


def _open_cells(cells: DataFrame, tile: int) -> DataFrame:
    """(a, b, crowded): links that join all candidates in cells of up to `tile` members, and the numbers of the other cells."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, -1

        def found(columns, upto):
            cell, rest = columns[0][:upto], [c[:upto] for c in columns[1:]]
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            fs, rs, full = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > tile:
                    full.append(int(cell[lo]))
                elif hi - lo > 1:
                    every = np.arange(hi - lo)
                    f, r = _forest(int(cell[lo]), *(c[lo:hi] for c in rest), every, every)
                    fs.append(f)
                    rs.append(r)
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (fs, rs))
            gone = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(a.tolist() + [None] * gone, pa.int64()), pa.array(b.tolist() + [None] * gone, pa.int64()), pa.array([None] * len(a) + full, pa.int32())], ["a", "b", "crowded"])

        for batch in stream:
            columns = [c.to_numpy() for c in batch.columns]
            columns[2], columns[3] = columns[2].view(np.uint64), columns[3].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            columns = [c[np.searchsorted(columns[0], crowded, "right") :] for c in columns]
            if not len(columns[0]):
                held = None
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last cell may go on in the next batch
            if last:
                yield from found(columns, last)
            held = [c[last:] for c in columns]
            if len(held[0]) > tile:  # named now, not kept
                yield from found(held, len(held[0]))
                crowded, held = int(held[0][0]), None
        if held is not None:
            yield from found(held, len(held[0]))

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(batches, "a long, b long, crowded int")


def _crowded_cells(cells: DataFrame, crowded: DataFrame, tile: int) -> DataFrame:
    """Links (a, b) that join all candidates in the cells crowded(crowded): cut into tiles by hash, every pair of tiles searched on its own."""
    # No more rows than there are cells, a number that does not grow with the texts.
    chosen = F.broadcast(crowded.distinct())
    mine = cells.join(chosen, F.col("cell") == F.col("crowded")).drop("crowded")
    sizes = mine.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")
    grids = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    dealt = mine.join(F.broadcast(sizes), "cell").select("cell", "digest", "code", "after", own.alias("own"), F.explode(grids).alias("grid"))
    task = F.shiftleft(F.col("cell").cast("long"), 40) + F.shiftleft(F.col("grid.i").cast("long"), 20) + F.col("grid.j")
    keyed = dealt.select(task.alias("task"), "cell", "digest", "code", "after", (F.col("own") == F.col("grid.j")).alias("right"), (F.col("grid.i") == F.col("grid.j")).alias("same"))

    def search(table: pa.Table) -> pa.Table:
        digest, code, after = (table.column(c).to_numpy() for c in ("digest", "code", "after"))
        left = right = np.arange(len(digest))
        if not table.column("same")[0].as_py():
            to = table.column("right").to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(~to), np.flatnonzero(to)
        if len(left) and len(right):
            f, r = _forest(table.column("cell")[0].as_py(), digest, code.view(np.uint64), after.view(np.uint64), left, right)
        else:
            f = r = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(f, pa.int64()), "b": pa.array(r, pa.int64())})

    return by_task(keyed, search)


def _candidates(distinct: DataFrame, tile: int) -> DataFrame:
    """Links (a, b) between digests that join all candidates, a spanning forest of each cell."""
    cells, files = _cells(distinct), files_for(distinct.count(), SETS)
    found = materialize(_open_cells(cells, tile), "candidates", files=files)
    links, crowded = found.where("a is not null").select("a", "b"), found.where("crowded is not null").select("crowded")
    if crowded.isEmpty():
        return links
    return links.union(materialize(_crowded_cells(cells, crowded, tile), "candidates", files=files))


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components, of links (node, root): a node keeps its least root, to which its other roots are linked.

    The cells of one group have few roots, so a member is left with one link or so instead of one for each cell.
    """
    least = links.distinct().withColumn("least", F.min("b").over(Window.partitionBy("a")))
    ends = F.explode(F.array(F.col("a"), F.col("b")))
    return least.select(ends.alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _links(members: DataFrame, sets: DataFrame, least: float, tile: int, most: int) -> DataFrame:
    """Links (a, b) of similarity `least` or more that join all such pairs inside the buckets of members(digest, bucket), `most` or fewer.

    Tiles of a crowded bucket are compared first, each in itself, so that pairs of tiles
    find most of their members joined.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = materialize(members.join(sizes, "bucket").withColumn("home", F.col("digest")), "loose-groups", files=files_for(most, ROWS))
    files = files_for(placed.count(), SETS)
    own = F.pmod(F.xxhash64("digest"), F.col("tiles"))
    links = materialize(_compare(placed.select("digest", "home", F.xxhash64("bucket", own).alias("bucket")), sets, least, 2 * tile), "set-links", files=files)
    crowded = placed.where("tiles > 1").select("digest", "bucket")
    if crowded.isEmpty():
        return links
    joined = contracted_components(links, links.count())
    homed = crowded.join(joined, F.col("digest") == F.col("node"), "left").select("digest", "bucket", F.coalesce("component", "digest").alias("home"))
    return links.union(materialize(_compare(homed, sets, least, tile), "set-links", files=files))


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", cell_tile: int = TILE, set_tile: int = 500) -> DataFrame:
    """(id, digest, component): component is the smallest id reachable over links of Jaccard similarity `least` or more.

    The fingerprint bounds are those of a similarity of 0.8; a lesser `least` would lose
    links and is refused. Texts without words are copies of each other and of nothing else.
    Rows with a null id take part; a component takes its name from its smallest id that is
    not null, and is null where there is none. Rows that repeat an id are kept as they
    come. An empty table gives no rows.
    """
    if least < 0.8:
        raise ValueError("fingerprint bounds hold from a similarity of 0.8 on")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["id"], T.StructField("digest", T.LongType()), T.StructField("words", T.BinaryType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = (shingle_set(t.as_py(), words) for t in batch.column(1))
            marks = [(_digest(s), fingerprints(s).tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in marks], pa.int64()), pa.array([w for _, w in marks], pa.binary())], ["id", "digest", "words"])

    marked = materialize(docs.mapInArrow(batches, schema), "set-fingerprints")
    distinct = materialize(marked.groupBy("digest").agg(F.min("id").alias("first"), F.first("words").alias("words")), "distinct-sets", files=files_for(marked.count(), SETS))
    most, links = distinct.count(), _candidates(distinct, cell_tile)
    loose = contracted_components(_stars(links), links.count())
    members = distinct.join(loose, F.col("digest") == F.col("node")).select("digest", "first", F.col("component").alias("bucket"))
    sets = shingle_sets(members, docs, words, files_for(most, SETS))
    links = _links(members.select("digest", "bucket"), sets, least, set_tile, most)
    joined = contracted_components(links, links.count())
    homes = distinct.join(joined, distinct.digest == joined.node, "left").select("digest", "first", F.coalesce("component", "digest").alias("root"))
    names = homes.groupBy("root").agg(F.min("first").alias("component"))
    named = homes.join(names, "root").select(F.col("digest").alias("d"), "component")
    return marked.join(named, marked.digest == named.d).select(F.col("id").alias(id_col), "digest", "component")
