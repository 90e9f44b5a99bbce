"""Benchmark passages in documents, edits allowed, by q-gram counts in diagonal bands.

A passage of m characters with at most k edits keeps m + 1 - q - k * q of its q-grams, all
within k diagonals. q is 8 where that leaves one gram to find, and smaller for short
passages, so that k stays the same share of every passage. Every document is searched for
the passages' q-grams; hits are counted in bands of 2k + 2 diagonals that overlap by half,
and only bands that reach the bound are aligned, within their diagonals.

Characters are code points, on both sides lower-cased and with runs of white space as one
space. The benchmark is cut into blocks in a written table; tasks read them one at a time,
so that neither the driver nor a task holds more than one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.storage import materialize

#: Longest q-gram; shorter passages have shorter ones.
Q = 8
#: Edits allowed for each character of a passage.
EDIT_RATE = 0.1
#: Characters of passages in one block, about.
BLOCK_CHARS = 2_000_000
#: Characters of documents that are searched at once.
CHUNK_CHARS = 400_000
_SPACE = re.compile(r"\s+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def normalize(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at either end."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, put together from powers of two."""
    count = len(codes) - q + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    part, out, done, size = codes.astype(np.uint64) * _ODD, None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            times = np.uint64(pow(_BASE, size, 1 << 64))
            if q & size:
                piece = part[done : done + count]
                out = piece if out is None else out * times + piece
                done += size
            if size * 2 > q:
                return out
            part = part[:-size] * times + part[size:]
            size *= 2


def edits_allowed(m: int, rate: float) -> int:
    return int(m * rate + 1e-9)


def gram_size(m: int, edits: int) -> int:
    """The longest q up to Q of which a passage keeps at least one gram through so many edits."""
    return max(1, min(Q, m // (edits + 1)))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits that turn the item into some stretch of text, with its start on a diagonal low..high.

    Row i of the table is kept for diagonals low - most .. high + most only.
    """
    a, b = low - most, high + most
    width = b - a + 1
    far = most + 1
    diagonals = np.arange(a, b + 1)
    steps = np.arange(width)
    row = np.where((diagonals >= low) & (diagonals <= high) & (diagonals >= 0) & (diagonals <= len(text)), 0, far)
    for i, c in enumerate(item):
        at = diagonals + i  # text position read by a match on each diagonal
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        new = row + ~same
        new[~inside] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a letter of the item left out
        valid = (at + 1 >= 0) & (at + 1 <= len(text))
        new[~valid] = far
        new = np.minimum.accumulate(new - steps) + steps  # letters put in
        new[~valid] = far
        row = np.minimum(new, far)
        if row.min() >= far:
            return far
    return int(row.min())


class GramTable:
    """The q-grams of passages that share one q, in order, with a sieve in front."""

    def __init__(self, q: int, passages: list[int], block: Block):
        self.q, self.block = q, block
        each = [grams(points(block.texts[i]), q) for i in passages]
        gram = np.concatenate([*each, np.zeros(0, np.uint64)])
        item = np.repeat(np.array(passages, np.int64), [len(g) for g in each])
        place = np.concatenate([*(np.arange(len(g)) for g in each), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.known, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        bits = min(26, max(16, int(np.ceil(np.log2(max(2, len(self.known))))) + 4))
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self._slot(self.known)] = True

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * _ODD) >> self.shift

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the text whose gram is a passage's, and which gram it is."""
        gram = grams(codes, self.q)
        at = np.flatnonzero(self.sieve[self._slot(gram)])
        where = np.minimum(np.searchsorted(self.known, gram[at]), len(self.known) - 1)
        real = self.known[where] == gram[at]
        return at[real], where[real]

    def bands(self, at: np.ndarray, where: np.ndarray) -> list[tuple[int, int]]:
        """(passage, band) of one document's hits that reach the passage's bound, most hits first."""
        block = self.block
        times = self.times[where]
        source = np.repeat(self.first[where] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        item, place, position = self.item[source], self.place[source], np.repeat(at, times)
        # A passage with fewer hits in the whole document than it needs is out.
        enough = np.bincount(item, minlength=len(block.texts))[item] >= block.need[item]
        item, place, position = item[enough], place[enough], position[enough]
        if not len(item):
            return []
        # Bands start at each multiple of k + 1 and are 2k + 2 wide: any k + 1 diagonals lie in one.
        band = (position - place + block.lengths[item]) // (block.edits[item] + 1)
        rows = np.stack([np.concatenate([item, item]), np.concatenate([band, band - 1]), np.concatenate([place, place])], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]  # each place of the passage counts once in a band
        item, band = rows[:, 0], rows[:, 1]
        cuts = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]), [True]]))
        count, item, band = np.diff(cuts), item[cuts[:-1]], band[cuts[:-1]]
        good = np.flatnonzero(count >= block.need[item])
        good = good[np.argsort(-count[good], kind="stable")]
        return list(zip(item[good].tolist(), band[good].tolist()))


class Block:
    """Some normalized passages with their ids, indexed by q-grams."""

    def __init__(self, ids: list, texts: list[str], rate: float):
        self.ids, self.texts = ids, texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.edits = np.array([edits_allowed(n, rate) for n in self.lengths.tolist()], np.int64)
        q = np.array([gram_size(n, k) for n, k in zip(self.lengths.tolist(), self.edits.tolist())], np.int64)
        self.need = self.lengths + 1 - q - self.edits * q
        self.tables = [GramTable(s, np.flatnonzero((q == s) & (self.lengths > 0)).tolist(), self) for s in np.unique(q[self.lengths > 0]).tolist()]

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each normalized text: passages found, by their position in the block, with the fewest edits."""
        out: list[dict[int, int]] = [{} for _ in texts]
        lo = 0
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        while lo < len(texts):
            base = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK_CHARS, side="right")))
            self._search_run(texts[lo:hi], (ends[lo:hi] - base).tolist(), out[lo:hi])
            lo = hi
        return out

    def _search_run(self, texts: list[str], ends: list[int], out: list[dict[int, int]]) -> None:
        codes = points("\n".join([*texts, ""]))  # no passage holds a line break, so no gram reaches over one
        starts = np.array([0, *ends[:-1]])
        for table in self.tables:
            at, where = table.hits(codes)
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                d = int(doc[a])
                text = codes[starts[d] : ends[d] - 1]
                for i, band in table.bands(at[a:b] - starts[d], where[a:b]):
                    self._align(i, band, texts[d], text, out[d])

    def _align(self, i: int, band: int, text: str, codes: np.ndarray, found: dict[int, int]) -> None:
        if found.get(i, 1) == 0:
            return
        k = int(self.edits[i])
        low = band * (k + 1) - int(self.lengths[i])
        # A verbatim passage is the alignment without edits.
        got = 0 if self.texts[i] in text else banded_distance(points(self.texts[i]), codes, low, low + 2 * k + 1, k)
        if got <= k:
            found[i] = min(got, found.get(i, got))


def write_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The benchmark as a written table of blocks (ids, texts), each of about block_chars characters.

    Null and blank passages are left out.
    """
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("texts", T.ArrayType(T.StringType()))])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, kind = [], [], 0, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([texts], pa.list_(pa.string()))], ["ids", "texts"])

        for batch in stream:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normalize(t)
                if text:
                    ids.append(i)
                    texts.append(text)
                    held += len(text)
                if held >= block_chars:
                    yield packed()
                    ids, texts, held = [], [], 0
        if texts:
            yield packed()

    return materialize(rows.repartition(max(1, -(-chars // block_chars))).mapInArrow(batches, schema), "benchmark-blocks")


@lru_cache(maxsize=1)
def _load(path: str, row: int, rate: float) -> Block:
    from pyarrow import fs, parquet

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with store.open_input_file(name) as source:
        for at, batch in enumerate(parquet.ParquetFile(source).iter_batches(batch_size=1, columns=["ids", "texts"])):
            if at == row:
                return Block(batch.column("ids")[0].as_py(), batch.column("texts")[0].as_py(), rate)
    raise IndexError(f"{path} has no block {row}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' columns with `leaks`, an array of (item, edits) of the passages that a whole text holds.

    Edits count characters, at most `rate` of the passage's. Null and empty texts hold
    nothing, and null or blank passages occur nowhere; equal passages are each reported;
    repeated rows are each searched; an empty table stays empty. Other columns pass through, but
    for one named leaks, which is replaced. A task keeps one block of the benchmark in
    memory and goes through the blocks back and forth, batch by batch.
    """
    leak = T.StructType([T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("edits", T.IntegerType())])
    docs = docs.drop("leaks")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", T.ArrayType(leak))])
    written = write_blocks(benchmark, item_col, text_col, block_chars)
    counted = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).orderBy("path").collect()  # one row for each file of blocks
    places = [(r.path, row) for r in counted for row in range(r.n)]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["leaks"].dataType)
        order = list(places)
        for batch in stream:
            texts = [normalize(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            rows: list[list[dict]] = [[] for _ in texts]
            for path, row in order:
                block = _load(path, row, rate)
                for held, found in zip(rows, block.search(texts)):
                    held += [{"item": block.ids[i], "edits": e} for i, e in found.items()]
            order.reverse()  # the block just used is the first of the next batch
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(rows, kind)], schema.names)

    return docs.mapInArrow(batches, schema)
