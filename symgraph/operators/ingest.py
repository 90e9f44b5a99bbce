"""Symbols of scanned files as the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import annotation_name, annotation_value
from symgraph.operators.dml import delete_files, first_wins, last_wins
from symgraph.storage import materialize

# Mapping annotations and the method they serve; resolver annotations, their parent type and operation.
REST_METHODS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
GQL_RESOLVERS = {
    "DgsQuery": ("Query", "query"), "DgsMutation": ("Mutation", "mutation"), "QueryMapping": ("Query", "query"),
    "MutationMapping": ("Mutation", "mutation"), "DgsData": ("Query", "query"), "SchemaMapping": ("Query", "query"),
}
#: Symbols of one file have ids within a run of this length: a file of at most 500,000 bytes cannot hold more.
RUN = 1_000_000


def _lookup(values: dict[str, str], key):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def file_ids(symbols: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(module, file_path, language, package_name, file_id): files count up by module, then by their order in it.

    Files known to stored(module, path, file_id) keep their ids; others follow the largest.
    A path is known within its module: paths are relative to their module's root.
    """
    files = symbols.select("module", "file_path", "file_ord", "language", "package_name").groupBy("module", "file_path").agg(F.min("file_ord").alias("o"), F.first("language").alias("language"), F.max("package_name").alias("package_name"))
    if stored is not None:
        known = stored.select("module", F.col("path").alias("file_path"), F.col("file_id").alias("known"))
        files = files.join(known, ["module", "file_path"], "left")
        top = stored.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    else:
        files = files.withColumn("known", F.lit(None).cast("long"))
        top = files.select(F.lit(0).cast("long").alias("top")).limit(1)
    fresh = files.where("known is null")
    sizes = fresh.groupBy("module").agg(F.count("*").alias("n"))
    ahead = sizes.select("module", (F.sum("n").over(Window.orderBy("module")) - F.col("n")).alias("before"))  # one row for each module
    numbered = fresh.join(ahead, "module").join(F.broadcast(top)).withColumn("file_id", F.col("top") + F.col("before") + F.row_number().over(Window.partitionBy("module").orderBy("o", "file_path")))
    columns = ["module", "file_path", "language", "package_name", "file_id"]
    return numbered.select(columns).union(files.where("known is not null").withColumnRenamed("known", "file_id").select(columns))


def nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each symbol; of symbols with equal file, name, kind and line the last write stays.

    The path of names above a symbol grows by one parent a round, for as many rounds as
    symbols nest; chains that are still open are a written table from the second round on.
    """
    rows = symbols.drop("language", "package_name").join(files.select("module", "file_path", "file_id", "package_name"), ["module", "file_path"])
    order = F.when(F.col("sym_ord") < RUN, F.col("sym_ord")).otherwise(F.raise_error(F.lit(f"a file holds more than {RUN} symbols")).cast("int"))
    rows = rows.withColumn("id", F.col("file_id") * RUN + order).withColumn("parent_id", F.col("file_id") * RUN + F.col("parent_ord"))
    rows = materialize(rows, "symbols-by-id")
    own = rows.select("id", "parent_id", "name")
    done, chain = None, own.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"))
    while True:
        ended = chain.where("up is null").select("id", "path")
        done = ended if done is None else done.union(ended)
        chain = chain.where("up is not null")
        if not chain.limit(1).count():
            break
        up = own.select(F.col("id").alias("u"), F.col("parent_id").alias("upper"), F.col("name").alias("above"))
        chain = materialize(chain.join(up, F.col("up") == F.col("u"), "left").select("id", F.col("upper").alias("up"), F.concat_ws(".", "above", "path").alias("path")), "name-chains")
    rows = rows.join(done, "id")
    prefix = F.when(F.col("package_name").isNotNull(), F.concat("package_name", F.lit("."))).otherwise(F.concat("file_path", F.lit("#")))
    rows = rows.withColumn("qualified", F.concat(prefix, "path")).drop("path", "package_name")
    return last_wins(rows, ["file_id", "name", "kind", "start_line"], "sym_ord")


def annotations(n: DataFrame) -> DataFrame:
    """(node_id, ord, name, value, raw); repeats stay."""
    raw = n.select(F.col("id").alias("node_id"), F.posexplode("annotations").alias("ord", "raw"))
    return raw.select("node_id", "ord", annotation_name(F.col("raw")).alias("name"), annotation_value(F.col("raw")).alias("value"), "raw")


def rest_endpoints(n: DataFrame) -> DataFrame:
    """(node_id, method, path) of mapped methods; the class's path stands ahead of the method's."""
    a = annotations(n).withColumn("method", _lookup(REST_METHODS, F.col("name"))).where("method is not null")
    kinds = n.select(F.col("id").alias("node_id"), "kind", "parent_id")
    base = a.join(kinds.where(F.col("kind").isin("class", "interface")), "node_id").where("name = 'RequestMapping'").groupBy(F.col("node_id").alias("owner")).agg(F.min_by(F.regexp_replace(F.coalesce("value", F.lit("")), "/+$", ""), "ord").alias("prefix"))
    own = a.join(kinds.where(~F.col("kind").isin("class", "interface")), "node_id").join(base, F.col("parent_id") == F.col("owner"), "left")
    tail = F.when(F.col("prefix").isNotNull() & F.col("value").isNull(), F.lit("")).otherwise(F.coalesce("value", F.lit("/")))
    path = F.concat(F.coalesce("prefix", F.lit("")), F.when((tail == "") | F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail)))
    # Equal rows are whole keys, so whichever is kept is the first.
    return own.select("node_id", "method", F.when(path == "", "/").otherwise(path).alias("path")).distinct()


def graphql_resolvers(n: DataFrame) -> DataFrame:
    """(node_id, operation_type, field_name, parent_type) of annotated resolver methods."""
    a = annotations(n).where(F.col("name").isin(list(GQL_RESOLVERS))).join(n.select(F.col("id").alias("node_id"), F.col("name").alias("method_name")), "node_id")
    field = F.regexp_extract("raw", "field\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    parent = F.regexp_extract("raw", "(?:parentType|typeName)\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    default_parent, default_op = (_lookup({k: v[i] for k, v in GQL_RESOLVERS.items()}, F.col("name")) for i in (0, 1))
    op = F.when(parent == "Mutation", "mutation").when(parent == "Subscription", "subscription").otherwise(default_op)
    out = a.select("node_id", "ord", op.alias("operation_type"), F.when(field != "", F.trim(field)).otherwise(F.col("method_name")).alias("field_name"), F.when(parent != "", F.trim(parent)).otherwise(default_parent).alias("parent_type"))
    return first_wins(out, ["node_id", "field_name", "parent_type"], "ord").drop("ord")


def call_sites(n: DataFrame) -> DataFrame:
    """(node_id, ord, target, receiver); repeats stay."""
    return n.select(F.col("id").alias("node_id"), F.posexplode("call_sites").alias("ord", "c")).select("node_id", "ord", "c.target", "c.receiver")


def jsx_usages(n: DataFrame) -> DataFrame:
    return n.select(F.col("id").alias("node_id"), F.explode("jsx_elements").alias("element_name")).distinct()


def graphql_operations(n: DataFrame) -> DataFrame:
    """(node_id, operation_type, fields) of operations in client code."""
    return n.where("gql_operation_type is not null").select(F.col("id").alias("node_id"), F.col("gql_operation_type").alias("operation_type"), F.col("gql_fields").alias("fields"))


def ingest(symbols: DataFrame, imports: DataFrame | None = None, contents: DataFrame | None = None, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the graph, written, from symbols (and imports(module, file_path, import_path)).

    contents(module, file_path, hash) gives files their hashes; files of stored(module,
    path, file_id) keep their ids. A symbol's order within its file has to stay below RUN.
    """
    symbols = materialize(symbols, "symbols")
    files = materialize(file_ids(symbols, stored), "files")
    hashes = contents.select("module", "file_path", "hash") if contents is not None else symbols.select("module", "file_path", F.lit(None).cast("string").alias("hash")).distinct()
    listed = files.join(hashes, ["module", "file_path"], "left").select("file_id", F.col("file_path").alias("path"), "hash", "language", "module", F.unix_timestamp(F.current_timestamp()).alias("scanned_at"))
    n = materialize(nodes(symbols, files), "nodes")
    tables = {"files": materialize(listed, "file-rows"), "nodes": n}
    side = {"annotations": annotations, "rest_endpoints": rest_endpoints, "graphql_resolvers": graphql_resolvers, "graphql_operations": graphql_operations, "call_sites": call_sites, "jsx_usages": jsx_usages}
    tables |= {name: materialize(make(n), name) for name, make in side.items()}
    if imports is not None:
        tables["file_imports"] = materialize(imports.join(files.select("module", "file_path", "file_id"), ["module", "file_path"]).select("file_id", "import_path").distinct(), "imports")
    return tables


def merge(old: dict[str, DataFrame], gone: DataFrame, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after gone(file_id) went with all that hangs on them and new rows came; edges have to be resolved again."""
    kept = delete_files({k: v for k, v in old.items() if k not in ("edges", "sources")}, gone)
    out = dict(kept)
    for name, rows in new.items():
        out[name] = materialize(kept[name].select(rows.columns).union(rows), name) if name in kept else rows
    return out
