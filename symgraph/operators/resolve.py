"""Edge resolution over the symbol tables: every resolver is a join with a ranked, keep-one choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import capitalized, normalize_path
from symgraph.storage import materialize

# What a relative import may leave out, in the order tried; annotation sets of beans, injection and entities.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
INJECTED, BEANS, ENTITIES = ["Autowired", "Inject"], ["Service", "Component", "Repository"], ["Entity", "Document", "DgsData"]


def path_prefixes(path: Column) -> Column:
    """The path and every part of it that ends ahead of a slash: turns a starts-with join into an equal one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def joined_path(folder: Column, relative: Column) -> Column:
    """folder/relative with . and .. worked out."""
    parts = F.split(F.concat(folder, F.lit("/"), relative), "/")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(F.startswith(folder, F.lit("/")), F.lit("/")).otherwise(""), F.array_join(walked, "/"))


def _first(rows: DataFrame, key: list[str], *order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def _edge(rows: DataFrame, kind: str, order: int, seq: Column, metadata: Column | None = None) -> DataFrame:
    return rows.select("source_id", "target_id", F.lit(kind).alias("kind"), (metadata if metadata is not None else F.lit(None)).cast("string").alias("metadata"), F.lit(order).alias("resolver"), seq.cast("long").alias("seq"))


def by_name(n: DataFrame) -> DataFrame:
    """Candidates with how many share the name, and the name within a module."""
    c = n.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("module").alias("t_module"), F.col("kind").alias("t_kind"))
    return c.withColumn("n_name", F.count("*").over(Window.partitionBy("t_name"))).withColumn("n_module", F.count("*").over(Window.partitionBy("t_name", "t_module")))


class Names:
    """Definitions by name as two written tables of one row a key, so that a name that stands in
    many modules is looked up by each use and never paired with all of them."""

    def __init__(self, n: DataFrame):
        spots = n.groupBy(F.col("name").alias("want"), "module").agg(F.count("*").alias("n"), F.min("id").alias("local"))
        #: (want, module, n, local): how many a module has of a name, and the first.
        self.spots = materialize(spots, "names-by-module")
        lone = self.spots.groupBy("want").agg(F.sum("n").alias("n"), F.min("local").alias("lone")).where("n = 1")
        #: (want, lone): names that stand once in all.
        self.lone = materialize(lone.drop("n"), "lone-names")

    def unqualified(self, wants: DataFrame) -> DataFrame:
        """wants(source_id, module, want, ...) with target_id: the only one of the name, else the only one in the module."""
        out = wants.join(self.lone, "want", "left").join(self.spots.where("n = 1").drop("n"), ["want", "module"], "left")
        return out.withColumn("target_id", F.coalesce("lone", "local")).where("target_id is not null").drop("lone", "local")

    def first_in_module(self, wants: DataFrame) -> DataFrame:
        """wants(source_id, module, want, ...) with target_id: the only one of the name, else the first in the module."""
        spots = self.spots.select(F.col("want").alias("w"), F.col("module").alias("m"), "local")
        out = wants.join(self.lone, "want", "left").join(spots, (F.col("want") == F.col("w")) & F.col("module").eqNullSafe(F.col("m")), "left")
        return out.withColumn("target_id", F.coalesce("lone", "local")).where("target_id is not null")


def _names(t: dict[str, DataFrame]) -> Names:
    return t.get("names") or Names(t["nodes"])


def _of(rows: DataFrame, of: DataFrame | None, source: str = "source_id") -> DataFrame:
    """The rows of sources in of(sid), or all."""
    return rows if of is None else rows.join(of, F.col(source) == F.col("sid"), "left_semi")


def _heads(t: dict[str, DataFrame]) -> DataFrame:
    """(file_id, source_id): the first top symbol of each file, from which its imports go."""
    return t["nodes"].where("parent_id is null").groupBy("file_id").agg(F.min("id").alias("source_id"))


def _tries(i: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, import_path, rank, found) of relative imports: the paths that each may mean, in order."""
    here = files.select("file_id", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    tries = i.where("import_path like '.%'").join(here, "file_id").withColumn("whole", joined_path(F.col("folder"), F.col("import_path")))
    return tries.select("source_id", "import_path", F.posexplode(F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat("whole", s))).alias("rank", "found"))


_DOTTED = "import_path like '%.%' and import_path not like '.%' and import_path not like '/%'"


def imports(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """From a file's first symbol: to a qualified name or a lone simple name, a relative path, or all of a package."""
    n, i = t["nodes"], t["file_imports"]
    top, head = n.where("parent_id is null"), _heads(t)
    i = _of(i.join(head, "file_id"), of).withColumn("simple", F.substring_index("import_path", ".", -1))
    dotted = i.where(_DOTTED)
    exact = n.groupBy("qualified").agg(F.min("id").alias("by_qualified"))
    lone = n.groupBy(F.col("name").alias("simple")).agg(F.count("*").alias("c"), F.min("id").alias("by_name")).where("c = 1").drop("c")
    named = dotted.where("import_path not like '%.*'").join(exact, F.col("import_path") == F.col("qualified"), "left").join(lone, "simple", "left").withColumn("target_id", F.coalesce("by_qualified", "by_name")).where("target_id is not null")
    stars = dotted.where("import_path like '%.*'").withColumn("package", F.regexp_replace("import_path", "\\.\\*$", ""))
    members = top.where("qualified like '%.%'").select(F.regexp_replace("qualified", "\\.[^.]+$", "").alias("package"), F.col("id").alias("target_id"))
    wild = stars.join(members, "package")
    files = t["files"].join(head.select("file_id", F.col("source_id").alias("target_id")), "file_id").select(F.col("path").alias("found"), "target_id")
    relative = _first(_tries(i, t["files"]).join(files, "found"), ["source_id", "import_path"], "rank")
    return reduce(DataFrame.union, [_edge(x, "imports", 0, F.lit(0)) for x in (named, wild, relative)])


def inheritance(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """extends and implements: the only symbol of that name, or the first in the same module."""
    n = t["nodes"]
    wants = n.where("extends_name is not null").select(F.col("id").alias("source_id"), "module", F.col("extends_name").alias("want"), F.lit("extends").alias("how"))
    wants = wants.union(n.select("id", "module", F.explode("implements_names"), F.lit("implements")))
    best = _names(t).first_in_module(_of(wants, of).distinct())
    return reduce(DataFrame.union, [_edge(best.where(F.col("how") == k), k, 1, F.lit(0)) for k in ("extends", "implements")])


def calls(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """Call sites to their targets, by the receiver's type where there is a receiver."""
    n = t["nodes"]
    sites = _of(t["call_sites"], of, "node_id").join(n.select(F.col("id").alias("node_id"), "module"), "node_id").withColumnRenamed("node_id", "source_id").withColumnRenamed("target", "want")
    has = F.coalesce(F.col("receiver") != "", F.lit(False))
    plain = _names(t).unqualified(sites.where(~has))
    called = sites.where(has)
    # The receiver's class: its name, its name with a capital, or a class whose name ends so. Every ending of a
    # class name is a row, and a receiver asks by three keys, so that this is one equal join.
    way = lambda tag, key, rank: F.struct(F.lit(tag).alias("tag"), key.alias("key"), F.lit(rank).alias("way"))
    receiver = F.col("receiver")
    keys = called.select("receiver").distinct().select("receiver", F.inline(F.array(way("name", receiver, 0), way("name", capitalized(receiver), 1), way("end", F.lower(receiver), 2))))
    named = n.select(F.col("id").alias("cand"), F.col("name").alias("cand_name"), F.col("module").alias("cand_module"), "kind")
    endings = F.transform(F.sequence(F.lit(1), F.length("cand_name")), lambda k: F.struct(F.lit("end").alias("tag"), F.lower(F.substring(F.col("cand_name"), k, F.length("cand_name"))).alias("key")))
    typed = F.col("kind").isin("class", "interface", "component") & (F.length("cand_name") > 0)
    known = F.concat(F.array(F.struct(F.lit("name").alias("tag"), F.col("cand_name").alias("key"))), F.when(typed, endings).otherwise(F.array().cast("array<struct<tag:string,key:string>>")))
    cands = keys.join(named.select("cand", "cand_module", F.inline(known)), ["tag", "key"])
    cands = cands.groupBy("receiver", "cand", "cand_module").agg(F.min("way").alias("way"))
    kids = n.where("parent_id is not null").groupBy(F.col("parent_id").alias("cand"), F.col("name").alias("want")).agg(F.min("id").alias("target_id"))
    # The best class of each receiver and method in each module, and in all; a class of the caller's own module goes first.
    best = F.min(F.struct("way", "cand", "target_id")).alias("best")
    here = materialize(cands.join(kids, "cand").groupBy("receiver", "want", F.col("cand_module").alias("module")).agg(best), "methods-by-module")
    anywhere = materialize(here.groupBy("receiver", "want").agg(F.min("best").alias("any")), "methods")
    found = called.join(here.where("module is not null"), ["receiver", "want", "module"], "left").join(anywhere, ["receiver", "want"], "left")
    found = materialize(found.withColumn("target_id", F.coalesce("best", "any")["target_id"]).drop("best", "any"), "calls-by-receiver")
    owned = found.where("target_id is not null")
    loose = Names(n.where("kind = 'method'")).unqualified(found.where("target_id is null").drop("target_id"))
    parts = [(plain, None), (owned, F.col("receiver")), (loose, F.col("receiver"))]
    return reduce(DataFrame.union, [_edge(x, "calls", 2, F.col("ord"), m) for x, m in parts])


def renders(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """Components used in JSX; names that are ambiguous even within the module are skipped."""
    n = t["nodes"]
    wants = _of(t["jsx_usages"], of, "node_id").where(F.substring("element_name", 1, 1) == F.upper(F.substring("element_name", 1, 1))).join(n.select(F.col("id").alias("node_id"), "module"), "node_id")
    return _edge(_names(t).unqualified(wants.select(F.col("node_id").alias("source_id"), "module", F.col("element_name").alias("want"))), "renders", 3, F.lit(0))


def graphql(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """Operations and resolvers to schema fields, and schema types to the classes that back them."""
    n = t["nodes"]
    fields = n.select(F.col("id").alias("target_id"), F.col("name").alias("field"), F.col("kind").alias("op"), F.col("parent_id").alias("t_parent"))
    wants = _of(n, of, "id").where("gql_operation_type is not null").select(F.col("id").alias("source_id"), F.col("gql_operation_type").alias("op"), F.posexplode("gql_fields").alias("ord", "field"))
    hits = wants.join(fields, ["op", "field"])
    per = Window.partitionBy("source_id", "ord")
    hits = hits.withColumn("c", F.count("*").over(per)).withColumn("tops", F.count_if(F.col("t_parent").isNull()).over(per)).where("c = 1 or (tops = 1 and t_parent is null)")
    r = _of(t["graphql_resolvers"], of, "node_id").withColumnRenamed("node_id", "source_id")
    roots = ["Query", "Mutation", "Subscription"]
    rooted = r.where(F.col("parent_type").isin(roots)).join(fields, (F.col("operation_type") == F.col("op")) & (F.col("field_name") == F.col("field")))
    types = n.where("kind = 'graphql-type'").select(F.col("id").alias("type_id"), F.col("name").alias("parent_type"))
    kids = fields.where("t_parent is not null").select(F.col("t_parent").alias("type_id"), F.col("field").alias("field_name"), "target_id")
    nested = _first(r.where(~F.col("parent_type").isin(roots)).join(types, "parent_type").join(kids, ["type_id", "field_name"]), ["source_id", "field_name", "parent_type"], "type_id", "target_id")
    entities = t["annotations"].where(F.col("name").isin(ENTITIES)).select(F.col("node_id").alias("target_id")).distinct()
    backing = n.where("kind = 'class'").select(F.col("id").alias("target_id"), "name").join(entities, "target_id", "left_semi")
    typed = _of(n, of, "id").where("kind = 'graphql-type' and parent_id is null").select(F.col("id").alias("source_id"), "name").join(backing, "name")
    return reduce(DataFrame.union, [_edge(hits, "gql_resolves", 4, F.col("ord")), _edge(rooted, "gql_resolves", 4, F.lit(0)), _edge(nested, "gql_resolves", 4, F.lit(0)), _edge(typed, "type_match", 4, F.lit(0))])


def rest(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """API calls to endpoints with the same path or one above it, by exploded prefixes and equal joins."""
    n = t["nodes"]
    e = t["rest_endpoints"].select(F.col("node_id").alias("target_id"), F.col("method").alias("e_method"), normalize_path(F.col("path")).alias("prefix"))
    made = _of(n, of, "id").where("api_path is not null").select(F.col("id").alias("source_id"), F.coalesce("api_method", F.lit("GET")).alias("method"), normalize_path(F.col("api_path")).alias("path"))
    tries = made.withColumn("e_method", F.explode(F.array_distinct(F.array("method", F.lit("ANY"))))).withColumn("prefix", F.explode(path_prefixes(F.col("path"))))
    return _edge(tries.join(e, ["e_method", "prefix"]), "rest_match", 5, F.lit(0))


def _injected(n: DataFrame, a: DataFrame) -> DataFrame:
    """(source_id, want, field_id): annotated fields, their class, and the type they ask for."""
    marked = a.where(F.col("name").isin(INJECTED)).select(F.col("node_id").alias("marked")).distinct()
    words = F.split(F.trim("signature"), "\\s+")
    fields = n.where("kind = 'field'").join(marked, F.col("id") == F.col("marked"), "left_semi")
    return fields.select(F.col("parent_id").alias("source_id"), F.when(F.size(words) >= 2, words[0]).alias("want"), F.col("id").alias("field_id")).where("want is not null")


def injects(t: dict[str, DataFrame], of: DataFrame | None = None) -> DataFrame:
    """Classes to the beans their annotated fields ask for: an implementing bean, else one of that name."""
    n, a = t["nodes"], t["annotations"]
    marked = lambda names: a.where(F.col("name").isin(names)).select(F.col("node_id").alias("marked")).distinct()
    owner = n.where("kind = 'class' and parent_id is null").select(F.col("id").alias("source_id"))
    fields = _of(_injected(n, a), of).join(owner, "source_id", "left_semi")
    beans = n.where("kind = 'class'").join(marked(BEANS), F.col("id") == F.col("marked"), "left_semi")
    by_type = beans.select("id", F.explode("implements_names").alias("want")).groupBy("want").agg(F.min("id").alias("implementing"))
    by_name = beans.groupBy(F.col("name").alias("want")).agg(F.min("id").alias("named"))
    out = fields.join(by_type, "want", "left").join(by_name, "want", "left").withColumn("target_id", F.coalesce("implementing", "named")).where("target_id is not null")
    return _edge(out, "injects", 6, F.col("field_id"), F.col("want"))


def _resolved(t: dict[str, DataFrame], of: DataFrame | None) -> DataFrame:
    t = t | {"names": Names(t["nodes"])}
    parts = [f(t, of) for f in ([imports] if "file_imports" in t else []) + [inheritance, calls, renders, graphql, rest, injects]]
    # Each resolver is written on its own: small plans, and nothing is worked out twice.
    parts = [materialize(part, "resolved") for part in parts]
    first = F.min(F.struct("resolver", "seq", F.coalesce("metadata", F.lit("")).alias("text"), "metadata")).alias("first")
    best = reduce(DataFrame.union, parts).groupBy("source_id", "target_id", "kind").agg(first)
    return best.select("source_id", "target_id", "kind", "first.metadata", "first.resolver", "first.seq")


def resolve_all(t: dict[str, DataFrame]) -> DataFrame:
    """(source_id, target_id, kind, metadata, resolver, seq): all resolvers in order; of equal edges the first written stays.

    Edges count as written by resolver, then by source and seq.
    """
    return materialize(_resolved(t, None), "edges")


def _tagged(tag: str, key: Column) -> Column:
    return F.concat(F.lit(f"{tag}:"), key).alias("key")


def asks(t: dict[str, DataFrame]) -> DataFrame:
    """(source_id, key): what each source's edges depend on: names, packages, paths of files and of endpoints."""
    n = t["nodes"]
    name = lambda rows, source, key: rows.select(F.col(source).alias("source_id"), _tagged("name", F.col(key)))
    each = lambda column: n.select("id", F.explode(column).alias("k"))
    prefixes = n.where("api_path is not null").select("id", F.explode(path_prefixes(normalize_path(F.col("api_path")))).alias("k"))
    parts = [
        name(n.where("extends_name is not null"), "id", "extends_name"), name(each("implements_names"), "id", "k"), name(each("gql_fields"), "id", "k"), name(n.where("kind = 'graphql-type'"), "id", "name"),
        name(t["call_sites"], "node_id", "target"), name(t["jsx_usages"], "node_id", "element_name"), name(t["graphql_resolvers"], "node_id", "field_name"), name(_injected(n, t["annotations"]), "source_id", "want"),
        prefixes.select(F.col("id").alias("source_id"), _tagged("rest", F.col("k"))),
    ]
    if "file_imports" in t:
        i = t["file_imports"].join(_heads(t), "file_id")
        dotted = i.where(_DOTTED)
        stars = dotted.where("import_path like '%.*'").select("source_id", _tagged("package", F.regexp_replace("import_path", "\\.\\*$", "")))
        parts += [dotted.select("source_id", _tagged("name", F.substring_index("import_path", ".", -1))), stars, _tries(i, t["files"]).select("source_id", _tagged("path", F.col("found")))]
    return reduce(DataFrame.union, parts)


def offers(t: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """(key): all that the symbols of files(file_id) can answer, in the keys of asks()."""
    n = t["nodes"].join(files, "file_id", "left_semi")
    package = n.where("parent_id is null and qualified like '%.%'").select(_tagged("package", F.regexp_replace("qualified", "\\.[^.]+$", "")))
    served = t["rest_endpoints"].join(n.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(_tagged("rest", normalize_path(F.col("path"))))
    paths = t["files"].join(files, "file_id", "left_semi").select(_tagged("path", F.col("path")))
    return reduce(DataFrame.union, [n.select(_tagged("name", F.col("name"))), n.select(F.explode("implements_names").alias("k")).select(_tagged("name", F.col("k"))), package, served, paths])


def resolve_changes(t: dict[str, DataFrame], edges: DataFrame, old: dict[str, DataFrame], gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """resolve_all(t) by making those edges again that a change can have touched; the others stay as they are in edges.

    old are the tables before the change, gone(file_id) the files whose symbols went, fresh(file_id) those
    whose symbols came. The answers that either side offers, or offered, are joined back to the sources that ask for them; all edges
    of these sources and of new symbols are resolved against all candidates.
    """
    changed = materialize(offers(old, gone).union(offers(t, fresh)).distinct(), "changed-keys")
    new = t["nodes"].join(fresh, "file_id", "left_semi").select(F.col("id").alias("sid"))
    asking = asks(t).join(changed, "key", "left_semi").select(F.col("source_id").alias("sid"))
    of = materialize(new.union(asking).distinct(), "asking")
    left = old["nodes"].join(gone, "file_id", "left_semi").select(F.col("id").alias("sid"))
    kept = edges.join(of.union(left), F.col("source_id") == F.col("sid"), "left_anti")
    again = _resolved(t, of)
    return materialize(kept.select(again.columns).union(again), "edges")
