"""Queries of the scanning, module, stack and document tools, over rows that the given tables are turned into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import text as X
from symgraph.operators import index, ingest, modules, resolve
from symgraph.operators import search as S
from symgraph.operators import sections as sec
from symgraph.sources import build_files, code, documents, test_markers
from symgraph.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# --- sources: every part becomes a Java file, every customer a TSX file --------

_JAVA = (
    "concat('package shop.b', p_size % 7, ';\n\n/* a { brace\n   in a comment */\n@Service(\"k', p_size, '\")\npublic class P', p_partkey, ' extends Base', p_size % 5, '<String> implements Priced, shop.Sold<Long> {\n"
    "    private int hidden;\n    protected String note = \"}\";\n\n    /** Counts ', p_size, '. */\n    @GetMapping(\"/p', p_size, '\")\n    public int op', p_size, '(int a,\n            int b) {\n        return helper.run', p_size, '(a) + other();\n    }\n}\n')"
)
_TSX = (
    "concat('import {{ x }} from \"./x', c_custkey % 9, '\"\n\nexport function Page', c_custkey, '(props) {{\n  const r = fetch(`/customers/$', '{{props.id}}/n', c_nationkey, '`)\n  return <Row value={{useItem(r)}} />\n}}\nfunction hidden() {{ return 1 }}\n"
    "export const useItem', c_nationkey, ' = (x) => {{ return x }}\n')"
)


def _tsx() -> str:
    return _TSX.replace("{{", "{").replace("}}", "}")


def _java_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.concat(F.lit("src/P"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file_path"), F.lit("java").alias("language"), F.col("p_partkey").cast("int").alias("file_ord"), F.expr(_JAVA.replace("\n", "\\n")).alias("text"))


_FILES_SQL = "SELECT *, row_number() OVER (ORDER BY p_brand, p_partkey) AS file_id FROM part"


@query("scan_java", """
    WITH s AS (
        SELECT p_partkey, p_size, 0 AS sym_ord, CAST(NULL AS INT) AS parent_ord, concat('P', p_partkey) AS name, 'class' AS kind, 'public' AS visibility, NULL AS doc_comment, concat('Base', p_size % 5) AS extends_name, 'Priced,Sold' AS implements_names,
               concat('@Service("k', p_size, '")') AS annotations, NULL AS calls, 6 AS start_line, 16 AS end_line FROM part
        UNION ALL SELECT p_partkey, p_size, 1, 0, 'note', 'field', 'protected', NULL, NULL, NULL, '', NULL, 8, 8 FROM part
        UNION ALL SELECT p_partkey, p_size, 2, 0, concat('op', p_size), 'method', 'public', concat('Counts ', p_size, '.'), NULL, NULL, concat('@GetMapping("/p', p_size, '")'), concat('helper.run', p_size, ',other'), 12, 15 FROM part)
    SELECT concat('src/P', p_partkey, '.java') AS file_path, concat('shop.b', p_size % 7) AS package_name, sym_ord, parent_ord, name, kind, visibility, doc_comment, extends_name, implements_names, annotations, calls, start_line, end_line FROM s""")
def scan_java(spark, sf):
    rows = code.extract_symbols(_java_files(spark, sf))
    calls = F.array_join(F.transform("call_sites", lambda c: F.concat_ws(".", c["receiver"], c["target"])), ",")
    return rows.select("file_path", "package_name", "sym_ord", "parent_ord", "name", "kind", "visibility", "doc_comment", "extends_name", F.array_join("implements_names", ",").alias("implements_names"), F.array_join("annotations", ",").alias("annotations"), calls.alias("calls"), "start_line", "end_line")


@query("scan_tsx", """
    WITH s AS (
        SELECT c_custkey, concat('Page', c_custkey) AS name, 'component' AS kind, 3 AS start_line, 6 AS end_line, 'Row' AS jsx, NULL AS api_method, NULL AS api_path FROM customer
        UNION ALL SELECT c_custkey, concat('Page', c_custkey), 'api-call', 4, 4, NULL, 'GET', concat('/customers/{param}/n', c_nationkey) FROM customer
        UNION ALL SELECT c_custkey, concat('useItem', c_nationkey), 'hook', 8, 8, NULL, NULL, NULL FROM customer)
    SELECT concat('web/c', c_custkey, '.tsx') AS file_path, name, kind, start_line, end_line, coalesce(jsx, '') AS jsx, api_method, api_path FROM s""")
def scan_tsx(spark, sf):
    files = table(spark, sf, "customer").select(F.lit("web").alias("module"), F.concat(F.lit("web/c"), F.col("c_custkey").cast("string"), F.lit(".tsx")).alias("file_path"), F.lit("tsx").alias("language"), F.col("c_custkey").cast("int").alias("file_ord"), F.expr(_tsx().replace("\n", "\\n")).alias("text"))
    rows = code.extract_symbols(files)
    return rows.select("file_path", "name", "kind", "start_line", "end_line", F.coalesce(F.array_join("jsx_elements", ","), F.lit("")).alias("jsx"), "api_method", "api_path")


@query("ingest_nodes", f"""
    WITH f AS ({_FILES_SQL})
    SELECT file_id * 1000000 AS id, CAST(NULL AS BIGINT) AS parent_id, concat('shop.b', p_size % 7, '.P', p_partkey) AS qualified, 'class' AS kind FROM f
    UNION ALL SELECT file_id * 1000000 + 1, file_id * 1000000, concat('shop.b', p_size % 7, '.P', p_partkey, '.note'), 'field' FROM f
    UNION ALL SELECT file_id * 1000000 + 2, file_id * 1000000, concat('shop.b', p_size % 7, '.P', p_partkey, '.op', p_size), 'method' FROM f""")
def ingest_nodes(spark, sf):
    return ingest.ingest(code.extract_symbols(_java_files(spark, sf)))["nodes"].select("id", "parent_id", "qualified", "kind")


@query("ingest_endpoints", f"""
    WITH f AS ({_FILES_SQL}) SELECT file_id * 1000000 + 2 AS node_id, 'GET' AS method, concat('/p', p_size) AS path FROM f""")
def ingest_endpoints(spark, sf):
    return ingest.ingest(code.extract_symbols(_java_files(spark, sf)))["rest_endpoints"].select("node_id", "method", "path")


_PAIR = "concat('public class K', p_partkey DIV 2, ' {\n  public void run() { help', p_partkey DIV 2, '(); }\n  public void help', p_partkey DIV 2, '() { }\n}\n')"


def _paired(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files of two modules with equal paths, and the ids under which every third of them is known."""
    parts = table(spark, sf, "part")
    path = F.expr("concat('src/K', p_partkey DIV 2, '.java')")
    module = F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd")
    files = parts.select(module.alias("module"), path.alias("file_path"), F.lit("java").alias("language"), F.col("p_partkey").cast("int").alias("file_ord"), F.expr(_PAIR.replace("\n", "\\n")).alias("text"))
    return files, parts.where("p_partkey % 3 = 0").select(module.alias("module"), path.alias("path"), F.col("p_partkey").cast("long").alias("file_id"))


@query("two_modules", """
    WITH top AS (SELECT max(p_partkey) AS t FROM part WHERE p_partkey % 3 = 0),
    f AS (
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS module, p_partkey // 2 AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey
               ELSE t + row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END, p_partkey) END AS file_id
        FROM part, top)
    SELECT module, concat('src/K', k, '.java') AS path, CAST(file_id AS BIGINT) AS file_id, CAST(file_id * 1000000 + 1 AS BIGINT) AS source_id, CAST(file_id * 1000000 + 2 AS BIGINT) AS target_id, 'calls' AS kind FROM f""")
def two_modules(spark, sf):
    """Ids and edges of two modules whose files have equal paths, one third of them known before."""
    files, known = _paired(spark, sf)
    t = ingest.ingest(code.extract_symbols(files), stored=known)
    edges = resolve.resolve_all(t)
    of = t["nodes"].select(F.col("id").alias("source_id"), "file_id")
    return edges.join(of, "source_id").join(t["files"].select("file_id", "module", "path"), "file_id").select("module", "path", "file_id", "source_id", "target_id", "kind")


_SDL = "concat('type T', s_suppkey, ' { id: ID!\n  f', s_nationkey, '(a: Int,\n    b: Int): String\n}\ntype Query { t', s_suppkey, ': T', s_suppkey, ' }\n')"
_RESOLVERS = (
    "concat('class R', p_partkey, ' {\n  @DgsData(\n    parentType = \"P', p_size, '\",\n    field = \"f', p_partkey, '\"\n  )\n  public int get', p_partkey, '() { return 1; } @DgsMutation public int add', p_partkey, '() { return 2; }\n}\n')"
)
_OPERATION = "concat('export const Q', c_custkey, ' = gql`\n  query Get', c_custkey, ' {\n    first', c_nationkey, ' {\n      inner\n    }\n    second\n  }\n`\n')"


def _made_files(spark: SparkSession, sf: str, name: str, key: str, ending: str, language: str, text: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col(key).cast("string"), F.lit(f".{ending}"))
    return table(spark, sf, name).select(F.lit("m").alias("module"), path.alias("file_path"), F.lit(language).alias("language"), F.col(key).cast("int").alias("file_ord"), F.expr(text.replace("\n", "\\n")).alias("text"))


@query("scan_graphql", """
    SELECT concat('src/', s_suppkey, '.graphql') AS file_path, x.* FROM supplier, LATERAL (
        SELECT 'graphql-type' AS kind, concat('T', s_suppkey) AS name, CAST(NULL AS INT) AS parent_ord, 1 AS start_line, 4 AS end_line
        UNION ALL SELECT 'field', 'id', 0, 1, 1 UNION ALL SELECT 'field', concat('f', s_nationkey), 0, 2, 3 UNION ALL SELECT 'query', concat('t', s_suppkey), NULL, 5, 5) x""")
def scan_graphql(spark, sf):
    return code.extract_symbols(_made_files(spark, sf, "supplier", "s_suppkey", "graphql", "graphql", _SDL)).select("file_path", "kind", "name", "parent_ord", "start_line", "end_line")


@query("graphql_resolvers", """
    SELECT name, operation_type, field_name, parent_type FROM part, LATERAL (
        SELECT concat('get', p_partkey) AS name, 'query' AS operation_type, concat('f', p_partkey) AS field_name, concat('P', p_size) AS parent_type
        UNION ALL SELECT concat('add', p_partkey), 'mutation', concat('add', p_partkey), 'Mutation') x""")
def graphql_resolvers(spark, sf):
    n = ingest.ingest(code.extract_symbols(_made_files(spark, sf, "part", "p_partkey", "java", "java", _RESOLVERS)))
    return n["graphql_resolvers"].join(n["nodes"].select(F.col("id").alias("node_id"), "name"), "node_id").select("name", "operation_type", "field_name", "parent_type")


@query("graphql_operations", "SELECT concat('Q', c_custkey) AS name, 'query' AS operation_type, concat('first', c_nationkey, ',second') AS fields FROM customer")
def graphql_operations(spark, sf):
    n = ingest.ingest(code.extract_symbols(_made_files(spark, sf, "customer", "c_custkey", "tsx", "tsx", _OPERATION)))
    named = n["nodes"].select(F.col("id").alias("node_id"), "name")
    return n["graphql_operations"].join(named, "node_id").select("name", "operation_type", F.array_join("fields", ",").alias("fields"))


_BUILD = {
    "maven": "concat('<project><properties><own.version>1.', p_size, '</own.version></properties><dependencies><dependency><groupId>g.', p_size, '</groupId><artifactId>a', p_partkey, '</artifactId><version>$', '{own.version}</version><scope>test</scope></dependency></dependencies></project>')",
    "gradle": "concat('dependencies {\n  implementation \"g.', p_size, ':a', p_partkey, ':2.', p_size, '\"\n}\n')",
    "sbt": "concat('libraryDependencies += \"g.', p_size, '\" %% \"a', p_partkey, '\" % \"3.', p_size, '\"\n')",
    "npm": "concat('{\"dependencies\": {\"a', p_partkey, '\": \"^4.', p_size, '\"}}')",
}


@query("build_dependencies", """
    SELECT concat('m', p_partkey, '/build') AS path, ['maven', 'gradle', 'sbt', 'npm'][p_partkey % 4 + 1] AS ecosystem, CASE WHEN p_partkey % 4 = 3 THEN concat('a', p_partkey) ELSE concat('g.', p_size, ':a', p_partkey) END AS artifact,
           concat(p_partkey % 4 + 1, '.', p_size) AS version, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'compile' END AS scope FROM part""")
def build_dependencies(spark, sf):
    kinds = list(_BUILD)
    which = F.col("p_partkey") % 4
    text = F.coalesce(*[F.when(which == i, F.expr(_BUILD[k].replace("\n", "\\n"))) for i, k in enumerate(kinds)])
    files = table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/build")).alias("path"), F.element_at(F.array(*[F.lit(k) for k in kinds]), which.cast("int") + 1).alias("ecosystem"), text.alias("text"))
    return build_files.dependencies(files).select("path", "ecosystem", "artifact", "version", "scope")


@query("module_summary", """
    SELECT p_brand AS module, count(*) AS total_files, 3 * count(*) AS total_symbols, string_agg(concat('P', p_partkey), ',' ORDER BY concat('src/P', p_partkey, '.java')) AS public_classes, count(*) AS public_methods,
           '@GetMapping,@Service' AS annotations, string_agg(concat('GET /p', p_size, ' P', p_partkey, '.op', p_size), ',' ORDER BY concat('src/P', p_partkey, '.java')) AS endpoints,
           concat(count(*), ' files, ', 3 * count(*), ' symbols | ', count(*), ' classes | ', count(*), ' public methods | ', count(*), ' REST endpoints') AS overview
    FROM part GROUP BY p_brand""")
def module_summary(spark, sf):
    files = _java_files(spark, sf)
    s = modules.summaries(code.extract_symbols(files), files)
    served = F.array_join(F.transform("rest_endpoints", lambda e: F.concat(e["method"], F.lit(" "), e["path"], F.lit(" "), e["handler"])), ",")
    return s.select("module", "total_files", "total_symbols", F.array_join("public_classes", ",").alias("public_classes"), "public_methods", F.array_join("annotations", ",").alias("annotations"), served.alias("endpoints"), modules.overview(s).alias("overview"))


@query("internal_api", """
    WITH p AS (SELECT *, concat(lower(replace(p_brand, '#', '-')), '-src-p', p_partkey, '-java') AS fid FROM part)
    SELECT p_brand AS module, concat(p_brand, '-overview') AS id, NULL AS parent_id, concat(p_brand, ' — Overview') AS title FROM part GROUP BY p_brand
    UNION ALL SELECT p_brand, concat(p_brand, '-rest-api'), NULL, 'REST API Endpoints' FROM part GROUP BY p_brand
    UNION ALL SELECT p_brand, concat(p_brand, '-endpoint-', row_number() OVER (PARTITION BY p_brand ORDER BY concat('src/P', p_partkey, '.java')) - 1), concat(p_brand, '-rest-api'), concat('GET /p', p_size) FROM part
    UNION ALL SELECT p_brand, concat(lower(replace(p_brand, '#', '-')), '-src'), NULL, 'src' FROM part GROUP BY p_brand
    UNION ALL SELECT p_brand, fid, concat(lower(replace(p_brand, '#', '-')), '-src'), concat('src/P', p_partkey, '.java') FROM p
    UNION ALL SELECT p_brand, concat(fid, '-class-p', p_partkey), fid, concat('class: P', p_partkey) FROM p
    UNION ALL SELECT p_brand, concat(fid, '-class-p', p_partkey, '-field-note'), concat(fid, '-class-p', p_partkey), 'field: note' FROM p
    UNION ALL SELECT p_brand, concat(fid, '-class-p', p_partkey, '-method-op', p_size), concat(fid, '-class-p', p_partkey), concat('method: op', p_size) FROM p""")
def internal_api(spark, sf):
    files = _java_files(spark, sf)
    return modules.doc_sections(code.extract_symbols(files), files).select("module", "id", "parent_id", "title")


@query("test_sources", """
    SELECT CAST(user_id AS VARCHAR) AS module, CAST(event_id AS VARCHAR) AS file_path FROM events WHERE event_id % 7 < 2 OR event_id % 11 = 0 OR event_id % 13 = 0""")
def test_sources(spark, sf):
    """Every event is a file; no build file names a test dependency, so that the built-in markers count."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("module"), F.col("event_id").cast("string").alias("file_path"), "event_id", "event_type")
    imported = F.when(F.col("event_id") % 7 == 0, "org.junit.jupiter.api.Test").when(F.col("event_id") % 7 == 1, "vitest/config").otherwise(F.concat(F.lit("app."), "event_type"))
    marks = F.when(F.col("event_id") % 11 == 0, F.array(F.lit("@Test(expected = X.class)"))).otherwise(F.array(F.lit("@Tried")))
    signature = F.when(F.col("event_id") % 13 == 0, "class A extends AnyFunSuite").otherwise("class A")
    markers = test_markers.detect_markers(e.select(F.col("event_type").alias("artifact"), F.lit("test").alias("scope")))
    return test_markers.test_files(e.select("module", "file_path", signature.alias("signature"), marks.alias("annotations")), e.select("module", "file_path", imported.alias("import_path")), markers)


# --- stack: parts stand for the frameworks found in brands ----------------------

_FOUND_SQL = """
    f AS (SELECT p_brand AS path, p_partkey AS rank, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'frontend' WHEN 1 THEN 'backend' ELSE 'container' END AS category,
          CASE WHEN p_size % 2 = 0 THEN concat(p_size, '.1') END AS version, split_part(p_name, ' ', 1) AS doc_key FROM part)"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("module"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("name"), F.when(size % 3 == 0, "frontend").when(size % 3 == 1, "backend").otherwise("container").alias("category"),
        F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(".1"))).alias("version"), F.substring_index("p_name", " ", 1).alias("doc_key"))


@query("stack_by_category", f"""
    WITH {_FOUND_SQL} SELECT category, name, version, doc_key FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_key ORDER BY path, rank) AS n FROM f) WHERE n = 1""")
def stack_by_category(spark, sf):
    return build_files.stack_by_category(_found(spark, sf))


@query("distinct_frameworks", f"""
    WITH {_FOUND_SQL} SELECT doc_key, version, count(*) OVER () AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY path, rank) AS n FROM f) WHERE n = 1""")
def distinct_frameworks(spark, sf):
    return build_files.distinct_frameworks(_found(spark, sf))


@query("detected_version", f"WITH {_FOUND_SQL} SELECT version AS v FROM f WHERE (doc_key = 'small' OR name = 'small') AND version IS NOT NULL ORDER BY path, rank LIMIT 1")
def detected_version(spark, sf):
    return _found(spark, sf).agg(build_files.detected_version("small").alias("v"))


@query("used_in", f"""
    WITH {_FOUND_SQL}, n AS (SELECT doc_key AS key, path FROM f UNION SELECT name, path FROM f)
    SELECT key, string_agg(path, ',' ORDER BY path) AS modules FROM n WHERE key IN (SELECT DISTINCT doc_key FROM f) GROUP BY key""")
def used_in(spark, sf):
    found = _found(spark, sf)
    return build_files.used_in(found, found.select(F.col("doc_key").alias("key")).distinct()).select("key", F.array_join("modules", ",").alias("modules"))


@query("module_types", f"""
    WITH {_FOUND_SQL} SELECT path, CASE WHEN bool_or(category = 'frontend') THEN 'frontend' WHEN bool_or(category = 'container') THEN 'infra' ELSE 'backend' END AS type FROM f GROUP BY path""")
def module_types(spark, sf):
    return _found(spark, sf).groupBy("path").agg(build_files.module_type(F.collect_set("category")).alias("type"))


# --- documents, paths and names ------------------------------------------------


@query("readme_choice", """
    WITH r AS (SELECT page_id // 22 AS repo, page_id % 22 AS rank, html FROM pages WHERE length(html) > 100)
    SELECT concat('org/r', repo) AS repo, md5(substring(html, 1, 30000)) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank) AS n FROM r) WHERE n = 1""")
def readme_choice(spark, sf):
    """Twenty-two pages in a row are one repository's files, under the branches and names that are tried."""
    tries = [f"{b}/{f}" for b in documents.BRANCHES for f in documents.READMES]
    pages = table(spark, sf, "pages").select(F.concat(F.lit("org/r"), F.floor(F.col("page_id") / 22).cast("string")).alias("repo"), F.array(*[F.lit(t) for t in tries])[(F.col("page_id") % 22).cast("int")].alias("file"), F.col("html").alias("text"))
    landed = documents.landed_texts(pages.select(F.concat(F.lit("https://raw.githubusercontent.com/"), "repo", F.lit("/"), "file").alias("url"), "text"))
    return documents.readmes(pages.select("repo").distinct(), landed).select("repo", F.md5("text").alias("text_md5"))


@query("sanitize_id", "SELECT doc_id, substring(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS id FROM documents")
def sanitize_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitize_id(F.col("text")).alias("id"))


@query("cache_key", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._@-]', '_', 'g') AS key FROM pages")
def cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.cache_key(F.col("url")).alias("key"))


@query("relative_paths", "SELECT page_id, replace(replace(concat('at ', url, ' below /en'), '/en/', ''), '/en', '.') AS message FROM pages")
def relative_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.relative_paths(F.concat(F.lit("at "), "url", F.lit(" below /en")), "/en").alias("message"))


@query("path_containment", "SELECT page_id, page_id % 5 > 0 AND page_id % 4 <= 2 AS inside FROM pages")
def path_containment(spark, sf):
    """Two directories down, then up as often as the page's number says; every fifth path is absolute."""
    up = F.expr("repeat('../', cast(page_id % 4 as int))")
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "/").otherwise(""), F.lit("a/b/"), up, F.lit("c"))
    return table(spark, sf, "pages").select("page_id", code.inside(path).alias("inside"))


def register(into_queries: dict, into_oracles: dict, headed, headed_sql: str, bm25_sql) -> None:
    """Add these queries, and those that share the catalog's heading fixture and its search SQL."""
    slug = "substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 60)"
    summary = "regexp_replace(regexp_replace(regexp_replace(content, '^#+[^\\n]*\\n', ''), '```[\\s\\S]*?```', '[code]', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"

    @query("tree_index", f"""
        WITH RECURSIVE {headed_sql},
        p AS (SELECT a.doc, a.ord, max(b.ord) AS parent_ord FROM sec a LEFT JOIN sec b ON a.doc = b.doc AND b.ord < a.ord AND b.level < a.level GROUP BY a.doc, a.ord),
        walk(doc, ord, nxt, depth) AS (SELECT doc, ord, parent_ord, 0 FROM p UNION ALL SELECT w.doc, w.ord, p.parent_ord, w.depth + 1 FROM walk w JOIN p ON p.doc = w.doc AND p.ord = w.nxt),
        d AS (SELECT doc, ord, max(depth) AS depth FROM walk GROUP BY doc, ord),
        f AS (SELECT s.*, d.depth, trim(string_split(regexp_replace({summary}, '^\\n+', ''), chr(10) || chr(10))[1], ' ') AS first FROM sec s JOIN d ON s.doc = d.doc AND s.ord = d.ord)
        SELECT doc, ord, concat(repeat('  ', depth), '- **', title, '** [`', {slug}, '`]', chr(10), repeat('  ', depth), '  ', CASE WHEN length(first) > 200 THEN concat(substring(first, 1, 197), '...') ELSE first END) AS text FROM f""")
    def tree_index(spark, sf):
        return modules.tree_lines(sec.nest_sections(headed(spark, sf)))

    def by_index(name: str, text: str, groups: list[list[str]]) -> None:
        @query(name, bm25_sql(groups))
        def run(spark, sf):
            index, lengths = S.write_index(table(spark, sf, "documents"), "doc_id", ["text"])
            return S.search_index(index, lengths, text, "doc_id", limit=None)

    by_index("search_index_or", "tion OR edes the", [["tion"], ["edes", "the"]])
    by_index("search_index_phrase", "apache_license", [["apache license"]])

    def by_blocks(name: str, text: str, groups: list[list[str]], limit: int | None, change: bool = False):
        top = "" if limit is None else f" ORDER BY rank, doc_id LIMIT {limit}"

        @query(name, f"SELECT * FROM ({bm25_sql(groups)}){top}")
        def run(spark, sf):
            """The index is made of two thirds of the documents and of others by their texts' halves, which are taken out again, or at once."""
            docs = table(spark, sf, "documents").select("doc_id", "text")
            if not change:
                return index.Index.build(docs, "doc_id", ["text"]).search(text, limit)
            half = docs.where("doc_id % 3 = 0").withColumn("text", F.expr("substr(text, 1, length(text) div 2)"))
            built = index.Index.build(docs.where("doc_id % 3 <> 0").union(half), "doc_id", ["text"])
            return built.remove(half).add(docs.where("doc_id % 3 = 0")).search(text, limit)

    by_blocks("search_blocks_top", "tion OR the OR edes", [["tion"], ["the"], ["edes"]], 20)
    by_blocks("search_blocks_changed", "tion OR the", [["tion"], ["the"]], 20, True)
    by_blocks("search_blocks_phrase", "apache_license OR edes the", [["apache license"], ["edes", "the"]], None, True)
    into_queries.update(QUERIES)
    into_oracles.update(ORACLES)
