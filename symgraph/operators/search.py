"""Full-text search with BM25 ranks over folded tokens: terms, phrases, AND groups joined by OR.

An index is two written tables, postings sorted by term and document lengths; without one
a search reads the texts once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import _MARKED, search_tokens
from symgraph.storage import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def sanitize_query(query: str) -> list[list[str]]:
    """OR groups of quoted tokens: operators' characters become spaces; OR at either end or doubled goes."""
    groups: list[list[str]] = [[]]
    for token in re.sub(r'[*:"^(){}\[\]]', " ", query).split():
        if token == "OR":
            if groups[-1]:
                groups.append([])
        else:
            groups[-1].append(token)
    return [g for g in groups if g]


def phrases_of(token: str) -> list[str]:
    """The index words of one query token; several make a phrase, none match nothing."""
    folded = "".join(_MARKED.get(c, c) for c in token).lower()
    return re.findall(r"[^\W_]+", folded)


def parse_query(query: str) -> list[list[tuple[str, ...]]]:
    """Groups of phrases; within a group all must occur, tokens without letters are left out."""
    groups = [[tuple(p) for t in g if (p := phrases_of(t))] for g in sanitize_query(query)]
    return [g for g in groups if g]


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, col, pos, term): the index as a table, for maintenance by id."""
    parts = [docs.select(F.col(id_col).alias("id"), F.lit(c).alias("col"), F.posexplode(search_tokens(F.col(c))).alias("pos", "term")) for c in columns]
    return reduce(DataFrame.union, parts)


def refresh_postings(index: DataFrame, changed: DataFrame, id_col: str, columns: list[str], removed: DataFrame | None = None) -> DataFrame:
    """The index after rows changed, were added or (removed(id)) deleted."""
    gone = changed.select(F.col(id_col).alias("id"))
    gone = gone.union(removed.select("id")) if removed is not None else gone
    return index.join(gone.distinct(), "id", "left_anti").union(postings(changed, id_col, columns))


def write_index(docs: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The postings and the document lengths (id, dl) as written tables.

    Postings are sorted by term over all files, so that a search skips the files and row
    groups whose range of terms holds none of its own.
    """
    index = materialize(postings(docs, id_col, columns).repartitionByRange("term", "id").sortWithinPartitions("term", "id", "col", "pos"), "postings")
    lengths = docs.select(F.col(id_col).alias("id"), reduce(lambda a, b: a + b, [F.size(search_tokens(F.col(c))) for c in columns]).alias("dl"))
    return index, materialize(lengths, "document-lengths")


def _counts_of(index: DataFrame, lengths: DataFrame, known: list[tuple[str, ...]]) -> DataFrame:
    """(id, dl, h0, h1, ...): occurrences of each phrase in every document, from the postings of the query's terms only.

    A phrase is a chain of equal joins on the next position in the same column.
    """
    terms = sorted({w for p in known for w in p})
    mine = index.where(F.col("term").isin(terms))
    hits = []
    for k, phrase in enumerate(known):
        run = mine.where(F.col("term") == phrase[0]).select("id", "col", "pos")
        for j, word in enumerate(phrase[1:], 1):
            later = mine.where(F.col("term") == word).select("id", "col", (F.col("pos") - j).alias("pos"))
            run = run.join(later, ["id", "col", "pos"], "left_semi")
        hits.append(run.groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(k).alias("k"), "n"))
    counted = reduce(DataFrame.union, hits).groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"h{k}") for k in range(len(known))])
    return lengths.join(counted.withColumnRenamed("id", "hit"), F.col("id") == F.col("hit"), "left").select("id", "dl", *[F.coalesce(f"h{k}", F.lit(0)).alias(f"h{k}") for k in range(len(known))])


def _counts_by_scan(docs: DataFrame, id_col: str, columns: list[str], known: list[tuple[str, ...]], kept: Column) -> DataFrame:
    """(id, kept, dl, h0, h1, ...) by one pass over the texts: tokens are exploded with those that follow them."""
    ahead = max(map(len, known))
    between = F.array(F.lit(None).cast("string"))  # no phrase reaches from one column into the next
    parts = [search_tokens(F.col(c)) for c in columns]
    every = F.concat(*[x for p in parts for x in (between, p)][1:])
    base = docs.select(F.col(id_col).alias("id"), kept.alias("kept"), every.alias("t"))
    windows = [F.col("t").alias("t0")] + [F.slice("t", j + 1, F.size("t")).alias(f"t{j}") for j in range(1, ahead)]
    each = base.select("id", "kept", F.explode_outer(F.arrays_zip(*windows)).alias("w")).select("id", "kept", "w.*")
    hit = lambda p: reduce(lambda a, b: a & b, [F.col(f"t{j}") == w for j, w in enumerate(p)])
    return each.groupBy("id").agg(F.first("kept").alias("kept"), F.count("t0").alias("dl"), *[F.count_if(hit(p)).alias(f"h{k}") for k, p in enumerate(known)])


def _ranked(counted: DataFrame, groups: list[list[tuple[str, ...]]], known: list[tuple[str, ...]], id_col: str, limit: int | None) -> DataFrame:
    """BM25 over a written table of counts: one row of statistics, then the documents that match."""
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"h{k}") > 0).alias(f"n{k}") for k in range(len(known))])
    matches = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"h{known.index(p)}") > 0 for p in g]) for g in groups])
    score = F.lit(0.0)
    for k in range(len(known)):
        n, tf = F.col(f"n{k}"), F.col(f"h{k}")
        idf = F.greatest(F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    ranked = counted.where(matches & F.col("kept")).join(F.broadcast(stats)).select("id", F.round(-score, 6).alias("rank"))
    if limit is not None:
        ranked = ranked.orderBy("rank", "id").limit(limit)
    return ranked.select(F.col("id").alias(id_col), "rank")


def _wanted(query: str) -> tuple[list[list[tuple[str, ...]]], list[tuple[str, ...]]]:
    groups = parse_query(query)
    return groups, sorted({p for g in groups for p in g})


def search(docs: DataFrame, query: str, id_col: str, columns: list[str], where: Column | None = None, limit: int | None = 20) -> DataFrame:
    """(id, rank) of matching rows; a lower rank is better, ties go by id.

    Corpus statistics cover all of docs; `where` filters after matching. The texts are read
    once and only counts are kept, as a written table; search_index() reads postings
    instead. Ids are unique. A query without words matches nothing.
    """
    groups, known = _wanted(query)
    if not known:
        return docs.select(F.col(id_col), F.lit(0.0).alias("rank")).limit(0)
    counted = _counts_by_scan(docs, id_col, columns, known, where if where is not None else F.lit(True))
    return _ranked(materialize(counted, "search-counts"), groups, known, id_col, limit)


def search_index(index: DataFrame, lengths: DataFrame, query: str, id_col: str, kept: DataFrame | None = None, limit: int | None = 20) -> DataFrame:
    """search() over what write_index() wrote; kept(id), where given, filters after matching."""
    groups, known = _wanted(query)
    if not known:
        return lengths.select(F.col("id").alias(id_col), F.lit(0.0).alias("rank")).limit(0)
    counted = _counts_of(index, lengths, known)
    if kept is None:
        counted = counted.withColumn("kept", F.lit(True))
    else:
        counted = counted.join(kept.select(F.col("id").alias("keep")), F.col("id") == F.col("keep"), "left").withColumn("kept", F.col("keep").isNotNull())
    return _ranked(materialize(counted, "search-counts"), groups, known, id_col, limit)


def named(nodes: DataFrame, name: str, kind: str | None = None, module: str | None = None) -> DataFrame:
    """Nodes of exactly this name, and kind and module where given."""
    out = nodes.where(F.col("name") == name)
    out = out.where(F.col("kind") == kind) if kind else out
    return out.where(F.col("module") == module) if module else out


def named_like_the_end(nodes: DataFrame, ending: str, kinds: tuple[str, ...] = ("class", "interface", "component")) -> DataFrame:
    """Nodes of these kinds whose name ends so, upper and lower case alike."""
    return nodes.where(F.endswith(F.lower("name"), F.lower(F.lit(ending))) & F.col("kind").isin(*kinds))
