"""What a scanned module offers: its summary, and its files and symbols as documentation sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import last_segments, sanitize_id

_SHOWN = ("public", "default")


def _bare(annotation: Column) -> Column:
    """An annotation without its arguments."""
    return F.regexp_replace(annotation, "\\(.*\\)", "")


def endpoints(symbols: DataFrame) -> DataFrame:
    """(module, file_path, sym_ord, method, path, handler) of the annotated members of shown top-level types.

    The annotation that holds Mapping counts, without the type's own path; a method it does not name is GET.
    """
    tops = symbols.where(F.col("parent_ord").isNull() & F.col("visibility").isin(*_SHOWN)).select("module", "file_path", F.col("sym_ord").alias("parent_ord"), F.col("name").alias("owner"))
    mapping = F.get(F.filter("annotations", lambda a: a.contains("Mapping")), F.lit(0))
    rows = symbols.withColumn("mapping", mapping).where("mapping is not null").join(tops, ["module", "file_path", "parent_ord"])
    method = reduce(lambda other, verb: F.when(F.col("mapping").contains(verb), verb.upper()).otherwise(other), ["Delete", "Put", "Post", "Get"], F.lit("GET"))
    path = F.regexp_extract("mapping", "[\"']([^\"']+)[\"']", 1)
    return rows.select("module", "file_path", "sym_ord", method.alias("method"), F.when(path != "", path).otherwise("/").alias("path"), F.concat("owner", F.lit("."), "name").alias("handler"))


def summaries(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each module of files(module, file_path): counts, type names, annotations, endpoints, entities, events.

    Names of types, annotations, entities and events come from top-level symbols that are
    public or without a modifier, annotations from their direct members too. Lists are in
    the order of path and line.
    """
    at = F.struct("file_path", "sym_ord")
    top = F.col("parent_ord").isNull() & F.col("visibility").isin(*_SHOWN)
    marks = F.transform(F.coalesce("annotations", F.array().cast("array<string>")), _bare)
    tops = symbols.where(top).select("module", "file_path", F.col("sym_ord").alias("up"))
    seen = symbols.withColumn("top", top).withColumn("marks", marks).join(tops, (F.col("parent_ord") == F.col("up")) & (symbols.module == tops.module) & (symbols.file_path == tops.file_path), "left").select(symbols["*"], "top", "marks", F.col("up").isNotNull().alias("under"))
    listed = lambda cond, value=F.col("name"): F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(at.alias("at"), value.alias("v"))))), lambda x: x["v"])
    event = F.filter("marks", lambda a: a.contains("Event") | a.contains("Listener"))
    out = seen.groupBy("module").agg(
        F.count("*").alias("total_symbols"),
        listed(F.col("top") & F.col("kind").isin("class", "case-class")).alias("public_classes"),
        listed(F.col("top") & F.col("kind").isin("interface", "trait")).alias("public_interfaces"),
        F.count_if((F.col("kind") == "method") & F.col("visibility").isin(*_SHOWN)).alias("public_methods"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("top") | F.col("under"), F.col("marks")))))).alias("annotations"),
        listed(F.col("top") & F.arrays_overlap("marks", F.array(F.lit("@Entity"), F.lit("@Document")))).alias("entities"),
        F.flatten(listed(F.col("top") & (F.size(event) > 0), F.transform(event, lambda _: F.col("name")))).alias("events"),
    )
    served = endpoints(symbols).groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "sym_ord", "method", "path", "handler"))), lambda e: F.struct(e["method"].alias("method"), e["path"].alias("path"), e["handler"].alias("handler"), e["file_path"].alias("file"))).alias("rest_endpoints"))
    counts = files.groupBy("module").agg(F.count("*").alias("total_files"))
    none = F.array().cast("array<string>")
    joined = counts.join(out, "module", "left").join(served, "module", "left")
    for c in ("public_classes", "public_interfaces", "annotations", "entities", "events"):
        joined = joined.withColumn(c, F.coalesce(c, none))
    return joined.withColumn("total_symbols", F.coalesce("total_symbols", F.lit(0))).withColumn("public_methods", F.coalesce("public_methods", F.lit(0)))


def overview(summary: DataFrame) -> Column:
    """The counts of a summaries() row in one line, parts that are zero left out."""
    many = lambda c, what: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" {what}")))
    return F.concat_ws(
        " | ", F.concat(F.col("total_files").cast("string"), F.lit(" files, "), F.col("total_symbols").cast("string"), F.lit(" symbols")), many("public_classes", "classes"), many("public_interfaces", "interfaces"),
        F.when(F.col("public_methods") > 0, F.concat(F.col("public_methods").cast("string"), F.lit(" public methods"))), many(F.coalesce("rest_endpoints", F.array()), "REST endpoints"), many("entities", "entities"),
    )


def doc_sections(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(module, ord, id, parent_id, title, summary): the module's overview, its endpoints, its directories with files and symbols.

    A symbol's summary is the first line of its comment, else its signature, each up to 120
    characters, else its kind. ord is a path of numbers and names that sorts sections into reading order.
    """
    s = summaries(symbols, files)
    row = lambda df, ord_, id_, parent, title, summary: df.select("module", ord_.alias("ord"), id_.alias("id"), parent.cast("string").alias("parent_id"), title.alias("title"), summary.alias("summary"))
    of = lambda suffix: F.concat("module", F.lit(suffix))
    first = row(s, F.array(F.lit("0")), of("-overview"), F.lit(None), F.concat("module", F.lit(" — Overview")), overview(s))
    served = s.where("rest_endpoints is not null")
    rest = row(served, F.array(F.lit("1")), of("-rest-api"), F.lit(None), F.lit("REST API Endpoints"), F.concat(F.size("rest_endpoints").cast("string"), F.lit(" endpoint(s) detected")))
    each = served.select("module", F.posexplode("rest_endpoints").alias("k", "e"))
    calls = row(each, F.array(F.lit("1"), F.lpad(F.col("k").cast("string"), 9, "0")), F.concat("module", F.lit("-endpoint-"), F.col("k").cast("string")), of("-rest-api"), F.concat("e.method", F.lit(" "), "e.path"), F.concat(F.lit("Handler: "), "e.handler"))
    f = files.withColumn("folder", F.regexp_replace("file_path", "/?[^/]*$", "")).withColumn("dir", last_segments(F.col("folder"), 2))
    dir_id = sanitize_id(F.concat("module", F.lit("-"), "dir"))
    dirs = f.groupBy("module", "dir").agg(F.count("*").alias("n"))
    folders = row(dirs, F.array(F.lit("2"), F.col("dir")), dir_id, F.lit(None), F.when(F.col("dir") == "", "root").otherwise(F.col("dir")), F.concat(F.col("n").cast("string"), F.lit(" file(s)")))
    file_id = sanitize_id(F.concat("module", F.lit("-"), last_segments(F.col("file_path"), 3)))
    tops = symbols.where("parent_ord is null").groupBy("module", "file_path").agg(F.count("*").alias("n"))
    listed = f.join(tops, ["module", "file_path"], "left")
    shown = row(listed, F.array(F.lit("2"), F.col("dir"), F.col("file_path")), file_id, dir_id, last_segments(F.col("file_path"), 3), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" exported symbol(s) — "), "language"))
    sym = symbols.join(f.select("module", "file_path", "dir"), ["module", "file_path"])
    own = sanitize_id(F.concat(file_id, F.lit("-"), F.col("kind"), F.lit("-"), F.col("name")))
    sym = sym.withColumn("own", own)
    up = sym.where("parent_ord is null").select("module", "file_path", F.col("sym_ord").alias("parent_ord"), F.col("own").alias("owner"))
    sym = sym.join(up, ["module", "file_path", "parent_ord"], "left").withColumn("file_section", file_id)
    under = F.when(F.col("parent_ord").isNull(), F.col("own")).otherwise(sanitize_id(F.concat("owner", F.lit("-"), "kind", F.lit("-"), "name")))
    text = F.coalesce(F.substring(F.substring_index("doc_comment", "\n", 1), 1, 120), F.substring("signature", 1, 120), "kind")
    leaves = row(sym, F.array(F.lit("2"), F.col("dir"), F.col("file_path"), F.lpad(F.col("sym_ord").cast("string"), 9, "0")), under, F.coalesce("owner", "file_section"), F.concat("kind", F.lit(": "), "name"), text)
    return reduce(DataFrame.union, [first, rest, calls, folders, shown, leaves])


def tree_lines(sections: DataFrame, most: int = 10) -> DataFrame:
    """(doc, ord, text): the index of nested sections as an indented list, ten levels deep at most.

    sections(doc, ord, level, title, section_id, summary, parent_ord) as nest_sections() gives them; levels are at most four,
    so a section's depth is the length of its chain of parents.
    """
    up = sections.select(F.col("doc").alias("d"), F.col("ord").alias("o"), F.col("parent_ord").alias("upper"))
    out = sections.withColumn("depth", F.lit(0)).withColumn("next", F.col("parent_ord"))
    for _ in range(3):
        out = out.join(up, (F.col("doc") == F.col("d")) & (F.col("next") == F.col("o")), "left").withColumn("depth", F.col("depth") + F.col("next").isNotNull().cast("int")).withColumn("next", F.col("upper")).drop("d", "o", "upper")
    pad = F.repeat(F.lit("  "), F.col("depth"))
    text = F.concat(pad, F.lit("- **"), "title", F.lit("** [`"), "section_id", F.lit("`]\n"), pad, F.lit("  "), F.coalesce("summary", F.lit("")))
    return out.where(F.col("depth") <= most).select("doc", "ord", text.alias("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """doc_sections() rows with a running number for each module."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy("ord", "id")))
