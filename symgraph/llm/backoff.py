"""Stupid-backoff language-model scores of a corpus's documents, by joins on n-gram counts.

The score of a word is c(context word) / c(context) for the longest context, at most
order - 1 words, with which it was seen, times alpha for each shorter one it fell back to;
without context it is c(word) / words, and 1 / (words + 1) for a word never seen. A document is
scored by the counts of all other documents: its own occurrences are taken off each count,
so that words do fall back, and a text that occurs twice scores apart from one that does not.

Each order is one join. The n-grams of a chunk of documents go to the part of their hash; a
part holds the count table of its n-grams, and answers every document's n-gram with what
other documents have of it. The answers of all orders meet the chunk's texts again, where
every word takes its longest n-gram that was seen. What moves is packed: one row for each
chunk, order and part, so rows grow with chunks and parts, never with n-grams of one kind.

n-grams go by 64-bit hashes: among n different ones, n * n / 2^65 clashes are to be expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.storage import materialize

_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ALPHA = 0.4
#: Characters of documents in one chunk, about; a longer document is a chunk of its own.
CHUNK_CHARS = 500_000
#: Characters of text whose n-grams one part holds, about; parts grow with the corpus, and no fewer than Spark's shuffle partitions.
PART_CHARS = 6_000_000
#: Slices of the chunks that are scored one after another, so that only one's texts and answers lie in shuffle files.
SLICES = 4


#: K^i and K^-i modulo 2^64 by i, grown as texts need.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x5851F42D4C957F2D


def _powers_to(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the text it stands in.

    Words end at ASCII white space; A-Z are lowered. All words come from one pass: prefix
    sums of byte times K^-i give each word's polynomial in K, which is then mixed with its length.
    """
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]) or b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = change[0::2], change[1::2]
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * down[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h ^= h >> np.uint64(29)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    return h, owner


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(words) - n + 1)
    out = words[:size].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD + words[k : k + size]
    return out ^ (out >> np.uint64(32))


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Each order's shuffle files go when its result is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def chunked(rows: DataFrame) -> DataFrame:
    """(chunk, ids, texts, words): rows(id, text) by the chunk, a written table; words is the number in all of a chunk's texts."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("words", T.LongType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def packed(kind) -> pa.RecordBatch:
            spaced = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
            space = (spaced == 32) | ((spaced >= 9) & (spaced <= 13))
            words = int((space[1:] & ~space[:-1]).sum())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([texts], pa.list_(pa.string())), pa.array([words], pa.int64())], schema.names)

        for batch in stream:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held + len(t or "") > CHUNK_CHARS and ids:
                    yield packed(kind)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t or "")
                held += len(t or "")
        if ids:
            yield packed(kind)

    return materialize(rows.mapInArrow(batches, schema), "chunks", "zstd")


class Grams:
    """The n-grams of one order in a chunk: the different ones of each document, by part, and where each position finds its own."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, n: int, parts: int):
        #: Positions of the words that end an n-gram within their document.
        self.ends = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]) + n - 1
        every = gram_hashes(words, n)[self.ends - n + 1]
        own = doc[self.ends]
        order = np.lexsort((every, own))
        gram, holder = every[order], own[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (holder[1:] != holder[:-1])
        starts = np.flatnonzero(fresh)
        gram = gram[starts]
        part = (gram % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        #: Hash and number of each entry, entries of one part together.
        self.gram, self.part = gram[by], part[by]
        self.times = np.diff(starts, append=len(every))[by].astype("<u4")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        #: The entry of each position in ends.
        self.entry = np.empty(len(every), np.int64)
        self.entry[order] = place[np.cumsum(fresh) - 1]


def asked(chunks: DataFrame, n: int, parts: int) -> DataFrame:
    """(part, chunk, grams, times): the n-grams of every document, packed by chunk and part."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = Grams(*word_hashes(texts.as_py()), n, parts)
                cuts = np.flatnonzero(np.concatenate([[True], g.part[1:] != g.part[:-1], [True]])) if len(g.part) else np.zeros(1, np.int64)
                spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(g.part[cuts[:-1]], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
                    pa.array([g.gram[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([g.times[a:b].tobytes() for a, b in spans], pa.binary()),
                ], ["part", "chunk", "grams", "times"])

    return chunks.select("chunk", "texts").mapInArrow(batches, "part int, chunk long, grams binary, times binary")


def answered(asks: DataFrame, n: int) -> DataFrame:
    """(chunk, n, part, width, others): for each n-gram asked for, how often it stands in other documents, in numbers of width bytes."""

    def count(table: pa.Table) -> pa.Table:
        grams, times = table.column("grams").to_pylist(), table.column("times").to_pylist()
        cuts = np.cumsum([0, *(len(t) // 4 for t in times)]).tolist()
        gram, own = np.frombuffer(b"".join(grams), "<u8"), np.frombuffer(b"".join(times), "<u4")
        del grams, times
        _, where = np.unique(gram, return_inverse=True)
        others = np.bincount(where, own).astype(np.int64)[where] - own
        others = others.astype("<u4" if others.max(initial=0) < 1 << 32 else "<u8")
        return pa.table({"chunk": table.column("chunk"), "n": pa.array([n] * table.num_rows, pa.int32()), "part": table.column("part"), "width": pa.array([others.itemsize] * table.num_rows, pa.int32()), "others": pa.array([others[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return asks.groupBy("part").applyInArrow(count, "chunk long, n int, part int, width int, others binary")


def _log_scores(words: np.ndarray, doc: np.ndarray, docs: int, others: list[np.ndarray], totals: np.ndarray, alpha: float) -> np.ndarray:
    """Summed log score of each document; others[n - 1] has a count for every position, zero where no n-gram ends."""
    first = np.zeros(len(doc), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    first[starts] = starts
    place = np.arange(len(doc)) - np.maximum.accumulate(first)  # of a word within its document
    longest = np.minimum(place + 1, len(others))
    value = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(totals[doc], 1)), -np.log(totals[doc] + 1.0))
    used = np.ones(len(doc), np.int64)
    for n in range(2, len(others) + 1):
        at = np.flatnonzero(others[n - 1] > 0)
        value[at] = np.log(others[n - 1][at]) - np.log(others[n - 2][at - 1])  # the context was seen wherever the n-gram was
        used[at] = n
    return np.bincount(doc, value + (longest - used) * np.log(alpha), docs)


def score_corpus(docs: DataFrame, order: int = 3, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of every row by the counts of all other rows.

    score_with() scores by a count table instead. A text without words has n_words 0, log_score 0 and a
    null mean; a null text counts as empty. Rows that repeat an id (or have none) are documents
    of their own, so a repeated row is seen in the other. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = chunked(rows)
    sizes = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.length(t))), F.lit(0)).alias("chars")).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.chars // PART_CHARS))
    all_words = sizes.words
    with _shuffles_removed(spark):
        answers = [materialize(answered(asked(chunks, n, parts), n), f"order-{n}-answers", "zstd") for n in range(1, order + 1)]
    every = answers[0]
    for more in answers[1:]:
        every = every.union(more)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def score(texts: pa.Table, given: pa.Table) -> pa.Table:
        found = sorted(zip(given.column("n").to_pylist(), given.column("part").to_pylist(), given.column("width").to_pylist(), given.column("others")), key=lambda r: r[:2])
        out = []
        for ids, held in zip(texts.column("ids"), texts.column("texts").to_pylist()):
            words, doc = word_hashes(held)
            others = []
            for n in range(1, order + 1):
                g = Grams(words, doc, n, parts)
                counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(o.as_py(), f"<u{w}").astype(np.int64) for k, _, w, o in found if k == n)])
                at = np.zeros(len(words), np.int64)
                at[g.ends] = counts[g.entry]
                others.append(at)
            size = np.bincount(doc, minlength=len(held))
            logs = _log_scores(words, doc, len(held), others, all_words - size, alpha)
            out.append(pa.table({"id": ids.values, "n_words": pa.array(size, pa.int64()), "log_score": pa.array(logs, pa.float64())}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], texts.schema.field("ids").type.value_type), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})

    scored = None
    with _shuffles_removed(spark):
        for k in range(SLICES):
            mine = F.pmod(F.xxhash64("chunk"), F.lit(SLICES)) == k
            held = chunks.where(mine).select("chunk", "ids", "texts").groupBy("chunk").cogroup(every.where(mine).groupBy("chunk"))
            done = materialize(held.applyInArrow(score, schema), "document-scores")
            scored = done if scored is None else scored.union(done)
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score").withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def count_table(docs: DataFrame, order: int = 3, text_col: str = "text") -> DataFrame:
    """(n, gram, count): all n-grams of up to `order` words, space-joined; n = 0 counts the words."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"))
    grams = [words.select(F.lit(n).alias("n"), F.explode(_grams(F.col("w"), n)).alias("gram")) for n in range(1, order + 1)]
    out = words.select(F.lit(0).alias("n"), F.lit("").alias("gram"), F.size("w").cast("long").alias("k")).groupBy("n", "gram").agg(F.sum("k").alias("count"))
    for each in grams:
        out = out.union(each.groupBy("n", "gram").agg(F.count("*").alias("count")))
    return out


def _grams(words, n: int):
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def score_with(docs: DataFrame, counts: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score) of docs against the counts of another corpus, backing off where needed.

    Every position is exploded with its n-grams of each order; the longest one counted
    wins, and each order given up costs a factor alpha. A word never counted gets
    alpha^(order - 1) / (words + 1). Ids are taken as unique.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_col).alias("id"), F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("w"))
    at = words.select("id", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"))).otherwise(F.array().cast("array<int>"))).alias("i"))
    tries = at.select("id", "i", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.col("i"))), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice("w", F.col("i") - n + 1, n), " ").alias("gram"), F.when(n > 1, F.array_join(F.slice("w", F.col("i") - n + 1, n - 1), " ")).otherwise(F.lit("")).alias("context")))).alias("t")).select("id", "i", "t.*")
    c = counts.select(F.col("n").alias("cn"), F.col("gram").alias("cg"), F.col("count").alias("top"))
    d = counts.select(F.col("n").alias("dn"), F.col("gram").alias("dg"), F.col("count").alias("base"))
    seen = tries.join(c, (F.col("n") == F.col("cn")) & (F.col("gram") == F.col("cg"))).join(d, (F.col("n") - 1 == F.col("dn")) & (F.col("context") == F.col("dg")))
    best = seen.groupBy("id", "i").agg(F.max("n").alias("n"), F.max_by(F.log(F.col("top") / F.col("base")), F.col("n")).alias("value"))
    total = counts.where("n = 0").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all_words"))
    scored = at.select("id", "i").join(best, ["id", "i"], "left").join(F.broadcast(total))
    fallen = F.least(F.lit(order), F.col("i")) - F.coalesce("n", F.lit(1))
    value = F.coalesce("value", -F.log(F.col("all_words") + 1)) + fallen * float(np.log(alpha))
    sums = scored.groupBy("id").agg(F.count("*").alias("n_words"), F.sum(value).alias("log_score"))
    none = words.where(F.size("w") == 0).select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_score"))
    return sums.union(none).withColumnRenamed("id", id_col)
