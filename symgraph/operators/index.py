"""A full-text index in segments, its postings in blocks of similar impact, so that a search reads few of them.

A segment is never changed. Postings are rows (term, block, id, dl, tf, places) sorted by term and
block in each file, where the block is the posting's share of the BM25 score in steps of 1 / LEVELS:
the best postings of a term lie together. Files are made where their documents are read: postings are
several times the texts as rows, and no shuffle moves them. A directory keeps each block's number of
postings in a file, greatest tf and smallest length, which bound its score whatever documents come later. What is removed is a row
(id, last segment that it holds for), and its terms are counted down, so that statistics are those of
an index made anew. More than SEGMENTS segments are merged into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import search_tokens
from symgraph.operators.search import K1, LEAST_IDF, B, parse_query
from symgraph.storage import materialize

#: Blocks for a unit of score share; shares are below 2.2, so a term has some 70 blocks at most.
LEVELS, SEGMENTS = 32, 8
#: A place is the column's number and the position in it.
COLUMN = 1 << 40
TABLES = ("postings", "directory", "totals", "removed", "minus")


def _share(tf: Column, dl: Column, avgdl) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _share_of(tf: float, dl: float, avgdl: float) -> float:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _length(columns: list[str]) -> Column:
    """The number of a document's words."""
    return reduce(lambda a, b: a + b, [F.size(search_tokens(F.col(c))) for c in columns]).cast("long")


def _terms(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, dl, term, places) of every document and term, in the partitions of docs.

    A document's words are sorted in its row, and each stretch of one word becomes a row: no
    shuffle brings together what one row holds. Steps are columns of their own, so that none is computed once for each word.
    """
    placed = lambda c, k: F.transform(search_tokens(F.col(c)), lambda w, i: F.struct(w.alias("term"), (i.cast("long") + k * COLUMN).alias("place")))
    held = docs.select(F.col(id_col).alias("id"), F.sort_array(F.concat(*[placed(c, k) for k, c in enumerate(columns)])).alias("held"))
    at = lambda i: F.col("held")[i]["term"]
    heads = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: (i == 0) | (at(i) != at(F.greatest(i - 1, F.lit(0)))))
    cut = held.select("id", "held", F.when(F.size("held") > 0, heads).alias("heads"))
    places = lambda i, k: F.transform(F.slice("held", i + 1, F.coalesce(F.get("heads", k + 1), F.size("held")) - i), lambda t: t["place"])
    each = F.transform("heads", lambda i, k: F.struct(at(i).alias("term"), places(i, k).alias("places")))
    return cut.select("id", F.size("held").cast("long").alias("dl"), F.explode(each).alias("t")).select("id", "dl", "t.term", "t.places")


def _summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, n, tf, dl) of every stretch of one term and block among sorted postings; a stretch ends with its batch."""
    for batch in stream:
        if batch.num_rows:
            term, block, tf, dl = batch.columns
            other = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(block[1:], block[:-1]))
            heads = np.concatenate(([0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1))
            n = np.diff(heads, append=batch.num_rows)
            at = pa.array(heads)
            yield pa.RecordBatch.from_arrays([term.take(at), block.take(at), pa.array(n), pa.array(np.maximum.reduceat(tf.to_numpy(), heads)), pa.array(np.minimum.reduceat(dl.to_numpy(), heads))], ["term", "block", "n", "tf", "dl"])


@dataclass
class Index:
    """Tables: postings, directory, totals (one row a segment), removed (id, upto), minus (term, n, docs, dl) by what was removed."""

    spark: SparkSession
    id_col: str
    columns: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    segments: int = 0
    #: Postings and blocks that the last search read.
    read: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, columns: list[str]) -> "Index":
        """An index over the columns of docs; ids are unique and not null."""
        return cls(docs.sparkSession, id_col, columns).add(docs)

    @classmethod
    def opened(cls, spark: SparkSession, id_col: str, columns: list[str], tables: dict[str, DataFrame]) -> "Index":
        """The index that these tables were saved from."""
        last = tables["totals"].agg(F.coalesce(F.max("segment") + 1, F.lit(0)).alias("n")).first().n
        return cls(spark, id_col, columns, dict(tables), last)

    def _put(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = self.tables[name].select(rows.columns).union(rows) if name in self.tables else rows

    def _write(self, terms: DataFrame, docs: int, avgdl: float) -> None:
        """One more segment of terms(id, dl, term, places); blocks are cut by avgdl, an estimate of their documents' length."""
        tf = F.size("places")
        rows = terms.select(F.lit(self.segments).alias("segment"), "term", F.floor(_share(tf, F.col("dl"), avgdl) * LEVELS).cast("int").alias("block"), "id", "dl", tf.alias("tf"), "places")
        postings = materialize(rows.sortWithinPartitions("term", "block", "id"), f"segment-{self.segments}", "zstd")
        directory = postings.select("term", "block", "tf", "dl").mapInArrow(_summed, "term string, block int, n long, tf int, dl long").select(F.lit(self.segments).alias("segment"), "*")
        dl = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("dl")).first().dl
        self._put("postings", postings)
        self._put("directory", materialize(directory, "directory", "zstd"))
        self._put("totals", materialize(self.spark.createDataFrame([(self.segments, docs, dl)], "segment int, docs long, dl long"), "totals"))
        self.segments += 1

    def add(self, docs: DataFrame) -> "Index":
        """Index more documents; an id that is in the index already has to be removed first."""
        spaces = reduce(lambda a, b: a + b, [F.coalesce(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1, F.lit(0)) for c in self.columns])
        sizes = docs.agg(F.count("*").alias("n"), F.avg(spaces).alias("dl")).first()
        self._write(_terms(docs, self.id_col, self.columns), sizes.n, max(sizes.dl or 0.0, 1.0))
        if self.segments > SEGMENTS:
            self._merge()
        return self

    def remove(self, docs: DataFrame) -> "Index":
        """Take documents out, given with their texts as they were indexed."""
        self._put("removed", materialize(docs.select(F.col(self.id_col).alias("id"), F.lit(self.segments - 1).alias("upto")), "removed"))
        none = F.lit(0).cast("long")
        total = docs.select(F.lit(None).cast("string").alias("term"), _length(self.columns).alias("dl")).groupBy("term").agg(none.alias("n"), F.count("*").alias("docs"), F.sum("dl").alias("dl"))
        held = F.array_distinct(F.concat(*[search_tokens(F.col(c)) for c in self.columns]))
        terms = docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n"), none.alias("docs"), none.alias("dl"))
        self._put("minus", materialize(terms.union(total).repartitionByRange("term").sortWithinPartitions("term"), "minus"))
        return self

    def _alive(self, rows: DataFrame) -> DataFrame:
        if "removed" not in self.tables:
            return rows
        gone = self.tables["removed"].groupBy(F.col("id").alias("gone")).agg(F.max("upto").alias("upto"))
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") <= F.col("upto")), "left_anti")

    def _merge(self) -> None:
        alive = self._alive(self.tables["postings"]).select("id", "dl", "term", "places")
        docs, dl = self._totals()
        merged = Index(self.spark, self.id_col, self.columns)
        merged._write(alive, docs, max(dl / docs, 1.0) if docs else 1.0)
        self.tables, self.segments = merged.tables, merged.segments

    def _totals(self) -> tuple[int, int]:
        t = self.tables["totals"].agg(F.sum("docs").alias("docs"), F.sum("dl").alias("dl")).first()
        m = self.tables["minus"].where("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first() if "minus" in self.tables else None
        return (t.docs - (m.docs if m else 0), t.dl - (m.dl if m else 0))

    # searches

    def search(self, query: str, limit: int | None = 20, kept: DataFrame | None = None) -> DataFrame:
        """(id, rank) of matching documents, a lower rank is better and ties go by id; statistics cover all, kept(id) filters matches.

        Where every alternative is one word and there is a limit, blocks that cannot reach the limit's score are not read.
        A query without words matches nothing.
        """
        groups = parse_query(query)
        known = sorted({p for g in groups for p in g})
        docs, dl = self._totals()
        none = self.tables["postings"].select(F.col("id").alias(self.id_col), F.lit(0.0).alias("rank")).limit(0)
        if not known or not docs:
            return none
        avgdl = max(dl, 1) / docs
        rows = self.tables["postings"].where(F.col("term").isin(sorted({w for p in known for w in p})))
        if limit is not None and all(len(g) == 1 and len(g[0]) == 1 for g in groups):
            rows, weights = self._pruned(rows, [p[0] for p in known], docs, avgdl, limit, kept)
            if not weights:
                return none
            ranked = self._scored(rows, weights, avgdl, kept)
        else:
            ranked = self._counted(rows, groups, known, docs, avgdl, kept)
        ranked = ranked.select("id", F.round(-F.col("score"), 6).alias("rank"))
        if limit is not None:
            ranked = ranked.orderBy("rank", "id").limit(limit)
        return ranked.select(F.col("id").alias(self.id_col), "rank")

    def _scored(self, rows: DataFrame, weights: dict[str, float], avgdl: float, kept: DataFrame | None) -> DataFrame:
        """(id, score): the sum of shares times weights."""
        weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("term")]
        scored = self._alive(rows).groupBy("id").agg(F.sum(weight * _share(F.col("tf"), F.col("dl"), avgdl)).alias("score"))
        return scored if kept is None else scored.join(kept.select("id"), "id", "left_semi")

    def _pruned(self, rows: DataFrame, words: list[str], docs: int, avgdl: float, limit: int, kept: DataFrame | None):
        """The postings that can reach the limit-th score, and each word's weight.

        The directory's rows of the query's words come to the driver: blocks of a word are some 70 in a segment.
        """
        blocks = self.tables["directory"].where(F.col("term").isin(words)).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl")).collect()
        gone = {r.term: r.n for r in self.tables["minus"].where(F.col("term").isin(words)).groupBy("term").agg(F.sum("n").alias("n")).collect()} if "minus" in self.tables else {}
        held: dict[str, list] = {}
        for r in blocks:
            held.setdefault(r.term, []).append(r)
        weights = {}
        for w in sorted(held):
            n = sum(r.n for r in held[w]) - gone.get(w, 0)
            weights[w] = max(log((docs - n + 0.5) / (n + 0.5)), LEAST_IDF)
        bound = {(r.term, r.block): weights[r.term] * _share_of(r.tf, r.dl, avgdl) for r in blocks}
        most = {w: max(bound[w, r.block] for r in held[w]) for w in held}
        # First the best blocks of each word alone: the limit-th score over them is one that has to be reached.
        first = {}
        for w, each in held.items():
            seen = 0
            for r in sorted(each, key=lambda r: -r.block):
                first[w], seen = r.block, seen + r.n
                if seen >= 2 * limit:
                    break
        self.read = {"postings": sum(r.n for r in blocks), "first": sum(r.n for r in blocks if r.block >= first[r.term])}
        upper = reduce(lambda a, b: a | b, [(F.col("term") == w) & (F.col("block") >= b) for w, b in first.items()]) if first else F.lit(False)
        best = self._scored(rows.where(upper), weights, avgdl, kept).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first() if first else None
        floor = best.least - 2e-6 if best and best.n == limit else None  # ranks are rounded
        low = {}
        for w in held:
            others = sum(v for u, v in most.items() if u != w)
            can = [r.block for r in held[w] if floor is None or bound[w, r.block] + others >= floor]
            if can:
                low[w] = min(can)
        self.read["second"] = sum(r.n for r in blocks if r.term in low and r.block >= low[r.term])
        wanted = reduce(lambda a, b: a | b, [(F.col("term") == w) & (F.col("block") >= b) for w, b in low.items()]) if low else F.lit(False)
        return rows.where(wanted), weights

    def _counted(self, rows: DataFrame, groups, known, docs: int, avgdl: float, kept: DataFrame | None) -> DataFrame:
        """(id, score) where phrases, or several words at once, have to be found: by document over all postings of the words."""
        words = sorted({w for p in known for w in p})
        by_word = self._alive(rows).groupBy("id", "dl").agg(*[F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("places")))).alias(f"w{k}") for k, w in enumerate(words)])
        at = lambda w, j: F.transform(F.col(f"w{words.index(w)}"), lambda x: x - j)
        hits = [F.size(reduce(F.array_intersect, [at(w, j) for j, w in enumerate(p)])).alias(f"h{k}") for k, p in enumerate(known)]
        counted = materialize(by_word.select("id", "dl", *hits), "search-counts")
        stats = counted.agg(*[F.count_if(F.col(f"h{k}") > 0).alias(f"n{k}") for k in range(len(known))]).first()
        self.read = {"postings": counted.count()}
        matches = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"h{known.index(p)}") > 0 for p in g]) for g in groups])
        score = F.lit(0.0)
        for k in range(len(known)):
            n = stats[f"n{k}"]
            score = score + F.lit(max(log((docs - n + 0.5) / (n + 0.5)), LEAST_IDF)) * _share(F.col(f"h{k}"), F.col("dl"), avgdl)
        scored = counted.where(matches).select("id", score.alias("score"))
        return scored if kept is None else scored.join(kept.select("id"), "id", "left_semi")
