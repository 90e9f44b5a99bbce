"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates, the sets themselves decide.

A SimHash bound wide enough for a similarity of 0.8 is about 16 of 64 bits; its cells would
be four bits wide and hold everything. Bands of ROWS minima meet with probability
1 - (1 - s^ROWS)^BANDS, 0.9993 at a similarity of 0.8 and more above, and rarely far below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.components import connected_components, local_forest
from symgraph.llm.simhash import by_task, shingle_hashes
from symgraph.storage import materialize

BANDS, ROWS = 14, 4
#: Bands searched in each round; what earlier rounds joined is not compared again.
ROUNDS = ((0, 2), (2, 6), (6, BANDS))
#: Shingles whose minima are taken at once.
PIECE = 4096

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    from xxhash import xxh64_intdigest

    return np.unique(shingle_hashes(text, words, lambda data: xxh64_intdigest(data, seed)))


def _digest(shingles: np.ndarray) -> int:
    """One signed number for the whole set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 1)).astype(np.int64))


def _bands(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(shingles), PIECE):
        least = np.minimum(least, (shingles[lo : lo + PIECE, None] * _TIMES + _PLUS).min(axis=0))
    return [_digest(band) for band in least.reshape(BANDS, ROWS)]


def _link(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float, group: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (left, right) of positions at a similarity of `least` or more that join all such pairs of different groups.

    A pair that other links, or its group, join already is not compared. Where left and
    right are the same, each pair is looked at once.
    """
    sizes = np.array([len(s) for s in sets])
    same = left is right
    xs: list[int] = []
    ys: list[int] = []
    for i in left.tolist():
        near = right[right > i] if same else right
        near = near[(group[near] != group[i]) & (np.minimum(sizes[near], sizes[i]) >= least * np.maximum(sizes[near], sizes[i]) - 1e-9)]
        if not len(near):
            continue
        flat = np.concatenate([sets[j] for j in near.tolist()])
        at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
        hits = near[common >= least * (sizes[i] + sizes[near] - common) - 1e-9]
        if len(hits):
            xs += [i] * len(hits)
            ys += hits.tolist()
            group[np.isin(group, group[hits])] = group[i]
    return xs, ys


def _members(distinct: DataFrame) -> DataFrame:
    """(digest, first, bucket, band): the members of every bucket of a band with more than one; of buckets with the same members one is kept."""
    members = distinct.select("digest", "first", F.posexplode("bands").alias("band", "value")).select("digest", "first", "band", F.xxhash64("band", "value").alias("bucket"))
    alike = [F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in range(2)]
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("band").alias("band"), *alike).where("n > 1").groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "bucket")).alias("b"))
    return materialize(members.drop("band").join(buckets.select("b.bucket", "b.band"), "bucket"), "band-members")


def _compare(members: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """Links (a, b) among the members(digest, bucket, home) of each bucket, compared by their sets(digest, shingles).

    A bucket of more than `tile` members is cut into tiles by hash and every pair of tiles
    is searched on its own. Members of one home are joined already.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.min("home").alias("lo"), F.max("home").alias("hi"))
    open_ = sizes.where("lo <> hi").select("bucket", "tiles")
    own = F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")
    grids = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    dealt = members.join(open_, "bucket").select("digest", "home", "bucket", own.alias("own"), F.explode(grids).alias("grid"))
    keyed = dealt.select("digest", "home", F.xxhash64("bucket", "grid").alias("task"), (F.col("own") == F.col("grid.j")).alias("right"), (F.col("grid.i") == F.col("grid.j")).alias("same"))

    def search(table: pa.Table) -> pa.Table:
        digest = table.column("digest").to_numpy()
        _, group = np.unique(table.column("home").to_numpy(), return_inverse=True)
        held = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]
        right = table.column("right").to_numpy(zero_copy_only=False)
        every = np.arange(len(held))
        if table.column("same")[0].as_py():
            xs, ys = _link(held, every, every, least, group)
        else:
            xs, ys = _link(held, every[~right], every[right], least, group)
        if not xs:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        f, r = local_forest(digest[xs], digest[ys])
        return pa.table({"a": pa.array(f, pa.int64()), "b": pa.array(r, pa.int64())})

    return by_task(keyed.join(sets, "digest").select("task", "digest", "home", "right", "same", "shingles"), search)


def shingle_sets(members: DataFrame, docs: DataFrame, words: int, files: int | None = None) -> DataFrame:
    """(digest, shingles) of members(first, ..) among others, from the texts of docs(id, text) with the ids `first`; in at most `files` files."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

    wanted = members.select(F.col("first").alias("__first")).distinct()
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("__first")), "left_semi").select("text")
    return materialize(texts.mapInArrow(batches, "digest long, shingles binary").dropDuplicates(["digest"]), "shingle-sets", files=files)


def near_pairs(distinct: DataFrame, docs: DataFrame, least: float, words: int, tile: int = 500) -> DataFrame:
    """Links (a, b) between digests of distinct(digest, first, bands) that join all candidates of similarity `least`.

    Bands are searched in ROUNDS: after each, buckets whose members are all joined go, so
    that sets of near copies travel for the first bands only. Texts of candidates are taken
    from docs(id, text) by the id `first`, so only theirs move.
    """
    members = _members(distinct)
    sets = shingle_sets(members, docs, words)
    links = None
    for lo, hi in ROUNDS:
        mine = members.where((F.col("band") >= lo) & (F.col("band") < hi)).select("digest", "bucket")
        if links is None:
            homed = mine.withColumn("home", F.col("digest"))
        else:
            joined = connected_components(links)
            homed = mine.join(joined, F.col("digest") == F.col("node"), "left").select("digest", "bucket", F.coalesce("component", "digest").alias("home"))
        found = materialize(_compare(homed, sets, least, tile), "set-links")
        links = found if links is None else links.union(found)
    return links


def near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, component): component is the smallest id reachable over links of Jaccard similarity `least` or more.

    Texts without words are copies of each other and of nothing else. Rows with a null id
    take part; a component takes its name from its smallest id that is not null, and is
    null where there is none. Rows that repeat an id are kept as they come. An empty table
    gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["id"], T.StructField("digest", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            digests, bands = [], []
            for t in batch.column(1):
                shingles = shingle_set(t.as_py(), words)
                digests.append(_digest(shingles))
                bands.append(_bands(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "bands"])

    marked = materialize(docs.mapInArrow(batches, schema), "shingle-bands")
    distinct = materialize(marked.groupBy("digest").agg(F.min("id").alias("first"), F.first("bands").alias("bands")), "distinct-sets")
    joined = connected_components(near_pairs(distinct, docs, least, words))
    homes = distinct.join(joined, distinct.digest == joined.node, "left").select("digest", "first", F.coalesce("component", "digest").alias("root"))
    names = homes.groupBy("root").agg(F.min("first").alias("component"))
    named = homes.join(names, "root").select(F.col("digest").alias("d"), "component")
    return marked.join(named, marked.digest == named.d).select(F.col("id").alias(id_col), "digest", "component")
