"""Heading sections of documents as flat rows, nested by window and join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import slugify, summarize

HEADING = "^(#{1,4}|={1,4})\\s+(.+)$"


def split_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ord, level, title, section_id, content, summary).

    A heading's content runs to the next heading of any level; what stands ahead of the
    first is dropped; a text without headings is one overview section. Fences do not count.
    """
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\\r?\\n")).alias("line", "text"))
    marked = lines.withColumn("level", F.length(F.regexp_extract("text", HEADING, 1))).withColumn("is_head", F.col("level") > 0)
    running = Window.partitionBy("doc").orderBy("line")
    numbered = marked.withColumn("ord", F.sum(F.col("is_head").cast("int")).over(running) - 1)
    body = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(~F.col("is_head"), F.struct("line", "text"))), lambda x: x.isNotNull())), lambda x: x["text"]), "\n")
    grouped = numbered.groupBy("doc", "ord").agg(
        F.max("level").alias("level"), F.max(F.when(F.col("is_head"), F.col("text"))).alias("head"), body.alias("content"), F.max(F.col("is_head").cast("int")).alias("heads")
    )
    grouped = grouped.withColumn("n_heads", F.max("ord").over(Window.partitionBy("doc")) + 1)
    clean = F.trim(F.regexp_replace(F.regexp_extract("head", HEADING, 2), "[*_`#]", ""))
    headed = grouped.where("ord >= 0").select("doc", "ord", "level", clean.alias("title"), F.trim("content").alias("content"))
    bare = grouped.where("ord < 0 and n_heads = 0").select("doc", F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), F.lit("Overview").alias("title"), F.trim("content").alias("content"))
    out = headed.select("doc", F.col("ord").cast("long").alias("ord"), "level", "title", "content").union(bare)
    return out.withColumn("section_id", slugify(F.col("title"))).withColumn("summary", summarize(F.col("content")))


def nest_sections(sections: DataFrame) -> DataFrame:
    """Each section with parent_ord: the nearest preceding heading of a smaller level.

    Levels are at most four, so the last ordinal of each level ahead of a row is a window
    maximum, and the parent is the largest of those of smaller levels.
    """
    ahead = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.max(F.when(F.col("level") == n, F.col("ord"))).over(ahead)) for n in (1, 2, 3)]
    return sections.withColumn("parent_ord", F.greatest(*last))


def section_map(sections: DataFrame) -> DataFrame:
    """(doc, section_id, content): of sections with one id the last wins."""
    return sections.groupBy("doc", "section_id").agg(F.max_by("content", "ord").alias("content"))


def full_document(sections: DataFrame) -> DataFrame:
    """(doc, content): all sections of a document under their headings, in order."""
    text = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"), F.lit("\n\n"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("ord", text.alias("text"))))
    return sections.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("content"))
