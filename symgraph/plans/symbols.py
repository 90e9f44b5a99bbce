"""Symbol tables made out of the order tables, for the edge resolvers to work on.

Suppliers are classes, parts are types, methods of those classes, and their injected fields,
nations are files, schema types and their fields, customers are client operations, orders
are call sites, pages are calls of endpoints. Each table is one SELECT that Spark and the
comparison engine both run; names collide on purpose, so that every rule of choice applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgraph.operators import resolve
from symgraph.tables import table

_NONE = "CAST(NULL AS VARCHAR(99)) AS"
_SUPPLIERS = "(SELECT count(*) AS n FROM {supplier}) AS s"

#: name -> SELECT; {table} stands for a given table, {list} for the engine's list constructor.
TABLES = {
    "classes": "SELECT s_suppkey AS id, concat('Svc', s_suppkey % 7) AS name, 'class' AS kind, concat('Brand#', s_nationkey) AS module, CAST(NULL AS BIGINT) AS parent_id, CAST(s_nationkey AS BIGINT) AS file_id, "
    "concat('shop.n', s_nationkey, '.Svc', s_suppkey % 7) AS qualified, concat('T', s_suppkey % 40) AS extends_name, {list}(concat('Svc', s_suppkey * 3 % 7), concat('T', s_suppkey % 90)) AS implements_names FROM {supplier}",
    "types": "SELECT 1000000 + p_partkey AS id, concat('T', p_partkey % 97) AS name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'component' END AS kind, p_brand AS module, CAST(NULL AS BIGINT) AS parent_id, "
    "CAST(1000 + p_partkey % 13 AS BIGINT) AS file_id, concat('shop.t', p_partkey % 13, '.T', p_partkey % 97) AS qualified, CASE WHEN p_size % 2 = 0 THEN concat('T', p_partkey * 7 % 120) END AS extends_name, "
    "{list}(concat('T', p_partkey * 5 % 130)) AS implements_names FROM {part}",
    "methods": "SELECT 2000000 + p_partkey AS id, concat('op', p_partkey % 61) AS name, 'method' AS kind, p_brand AS module, CAST(p_partkey % s.n AS BIGINT) AS parent_id, CAST(5000 AS BIGINT) AS file_id, concat('shop.m.op', p_partkey) AS qualified, "
    f"{_NONE} extends_name, {{list}}() AS implements_names FROM {{part}}, {_SUPPLIERS}",
    "fields": f"SELECT 3000000 + p_partkey AS id, 'dep' AS name, CAST(p_partkey % s.n AS BIGINT) AS parent_id, concat('T', p_partkey * 5 % 97, ' dep') AS signature, p_size FROM {{part}}, {_SUPPLIERS}",
    "sites": "SELECT 2000000 + o_custkey % p.n AS node_id, CAST(o_orderkey AS BIGINT) AS ord, CASE WHEN o_orderkey % 4 = 0 THEN concat('T', o_orderkey % 300) ELSE concat('op', o_orderkey % 61) END AS target, "
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('svc', o_custkey % 9) WHEN 2 THEN concat('Svc', o_custkey % 9) ELSE concat('c', o_custkey % 9) END AS receiver FROM {orders}, (SELECT count(*) AS n FROM {part}) AS p",
    "jsx": "SELECT 1000000 + p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 'div' ELSE concat('T', p_partkey * 11 % 150) END AS element_name FROM {part}",
    "files": "SELECT CAST(n_nationkey AS BIGINT) AS file_id, concat('src/n', n_nationkey, '.ts') AS path FROM {nation} UNION ALL SELECT DISTINCT CAST(1000 + p_partkey % 13 AS BIGINT), concat('src/t/', p_partkey % 13, '.ts') FROM {part}",
    "imports": "SELECT CAST(n_nationkey AS BIGINT) AS file_id, concat('shop.t', n_nationkey % 13, '.T', n_nationkey) AS import_path FROM {nation} UNION ALL SELECT CAST(n_nationkey AS BIGINT), concat('any.Svc', n_nationkey % 9) FROM {nation} "
    "UNION ALL SELECT CAST(n_nationkey AS BIGINT), concat('shop.t', n_nationkey % 15, '.*') FROM {nation} UNION ALL SELECT CAST(n_nationkey AS BIGINT), concat('./t/', n_nationkey % 17) FROM {nation} "
    "UNION ALL SELECT CAST(n_nationkey AS BIGINT), concat('../src/n', n_nationkey * 3 % 40) FROM {nation} UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'react' FROM {nation}",
    "schema": "SELECT 4000000 + n_nationkey AS id, concat('f', n_nationkey % 20) AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'mutation' ELSE 'query' END AS kind, CASE WHEN n_nationkey < 22 THEN CAST(NULL AS BIGINT) ELSE CAST(4000000 AS BIGINT) END AS parent_id FROM {nation} "
    "UNION ALL SELECT 6000000 + n_nationkey, concat('G', n_nationkey % 12), 'graphql-type', CAST(NULL AS BIGINT) FROM {nation} UNION ALL SELECT 7000000 + n_nationkey, concat('f', n_nationkey % 20), 'field', CAST(6000000 + n_nationkey AS BIGINT) FROM {nation} "
    "UNION ALL SELECT 8000000 + s_suppkey, concat('G', s_suppkey % 12), 'class', CAST(NULL AS BIGINT) FROM {supplier}",
    "operations": "SELECT 5000000 + c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'mutation' ELSE 'query' END AS gql_operation_type, {list}(concat('f', c_custkey % 25), concat('f', c_custkey * 3 % 25)) AS gql_fields FROM {customer}",
    "resolvers": "SELECT 2000000 + p_partkey AS node_id, CASE WHEN p_partkey % 3 = 1 THEN 'mutation' ELSE 'query' END AS operation_type, concat('f', p_partkey % 25) AS field_name, "
    "CASE p_partkey % 3 WHEN 0 THEN 'Query' WHEN 1 THEN 'Mutation' ELSE concat('G', p_partkey % 12) END AS parent_type FROM {part}",
    "entities": "SELECT 8000000 + s_suppkey AS node_id, 'Entity' AS name FROM {supplier} WHERE s_suppkey % 2 = 0",
    "marks": "SELECT 3000000 + p_partkey AS node_id, CASE WHEN p_size % 2 = 0 THEN 'Autowired' ELSE 'Inject' END AS name FROM {part} WHERE p_size % 5 > 0 UNION ALL SELECT 1000000 + p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Service' ELSE 'Component' END FROM {part} WHERE p_size % 4 > 0",
    "requests": "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS api_method, CASE WHEN page_id % 5 > 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS api_path FROM {pages}",
    "endpoints": "SELECT 100000 + min(page_id) AS node_id, method, path FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'POST' ELSE 'GET' END AS method, "
    "concat(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^/?#]*)', 1), CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END) AS path FROM {pages}) AS p WHERE path <> '' GROUP BY method, path",
}
_BASE = ("part", "supplier", "nation", "orders", "customer", "pages")


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name]
    used = {n: table(spark, sf_dir, n) for n in _BASE if f"{{{n}}}" in text}
    text = text.replace("{list}", "array")
    if name == "methods":
        text = text.replace("array()", "CAST(array() AS ARRAY<STRING>)")
    return spark.sql(text, **used)


def made_sql(*names: str) -> str:
    """The tables as common table expressions."""
    parts = []
    for name in names:
        text = TABLES[name].replace("{list}()", "CAST([] AS VARCHAR[])").replace("{list}", "list_value").replace("VARCHAR(99)", "VARCHAR")
        for n in _BASE:
            text = text.replace(f"{{{n}}}", n)
        parts.append(f"{name} AS ({text})")
    return ", ".join(parts)


def _nodes(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = made(spark, sf_dir, names[0])
    for name in names[1:]:
        out = out.unionByName(made(spark, sf_dir, name), allowMissingColumns=True)
    return out


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"nodes": _nodes(spark, sf_dir, "classes", "types", "methods"), "files": made(spark, sf_dir, "files"), "file_imports": made(spark, sf_dir, "imports")}
    return resolve.imports(t).select("source_id", "target_id", "kind")


IMPORTS_SQL = f"""
    WITH {made_sql("classes", "types", "methods", "files", "imports")},
    n AS (SELECT * FROM classes UNION ALL SELECT * FROM types UNION ALL SELECT * FROM methods), top AS (SELECT * FROM n WHERE parent_id IS NULL),
    head AS (SELECT file_id, min(id) AS source_id FROM top GROUP BY file_id), i AS (SELECT i.*, h.source_id, list_last(string_split(import_path, '.')) AS simple FROM imports i JOIN head h USING (file_id)),
    exact AS (SELECT qualified, min(id) AS by_q FROM n GROUP BY qualified), lone AS (SELECT name, min(id) AS by_n FROM n GROUP BY name HAVING count(*) = 1)
    SELECT source_id, coalesce(by_q, by_n) AS target_id, 'imports' AS kind FROM i LEFT JOIN exact ON import_path = qualified LEFT JOIN lone ON simple = name
    WHERE import_path LIKE '%.%' AND import_path NOT LIKE '.%' AND import_path NOT LIKE '%.*' AND coalesce(by_q, by_n) IS NOT NULL
    UNION ALL SELECT i.source_id, t.id, 'imports' FROM i JOIN top t ON import_path LIKE '%.*' AND concat(regexp_replace(t.qualified, '\\.[^.]+$', ''), '.*') = import_path
    UNION ALL SELECT i.source_id, h.source_id, 'imports' FROM i JOIN files f ON f.path = concat(replace(replace(i.import_path, './t/', 'src/t/'), '../src/', 'src/'), '.ts') JOIN head h ON h.file_id = f.file_id WHERE i.import_path LIKE '.%'"""

_COUNTED = "SELECT *, count(*) OVER (PARTITION BY name) AS n_name, count(*) OVER (PARTITION BY name, module) AS n_module FROM"


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.inheritance({"nodes": _nodes(spark, sf_dir, "classes", "types", "methods")}).select("source_id", "target_id", "kind")


INHERITANCE_SQL = f"""
    WITH {made_sql("classes", "types", "methods")}, n AS (SELECT * FROM classes UNION ALL SELECT * FROM types UNION ALL SELECT * FROM methods), c AS ({_COUNTED} n),
    w AS (SELECT id, module, extends_name AS want, 'extends' AS how FROM n WHERE extends_name IS NOT NULL UNION ALL SELECT id, module, unnest(implements_names), 'implements' FROM n)
    SELECT w.id AS source_id, min(c.id) AS target_id, how AS kind FROM w JOIN c ON want = c.name AND (n_name = 1 OR w.module = c.module) GROUP BY w.id, want, how"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"nodes": _nodes(spark, sf_dir, "classes", "types", "methods"), "call_sites": made(spark, sf_dir, "sites")}
    return resolve.calls(t).select("source_id", "target_id", "kind", "metadata", "seq")


CALLS_SQL = f"""
    WITH {made_sql("classes", "types", "methods", "sites")}, n AS (SELECT * FROM classes UNION ALL SELECT * FROM types UNION ALL SELECT * FROM methods), c AS ({_COUNTED} n), m AS ({_COUNTED} methods),
    s AS (SELECT node_id AS source_id, ord, target AS want, receiver, n.module FROM sites JOIN n ON node_id = n.id),
    d AS (
        SELECT r.receiver, n.id AS cand, n.module AS cm, CASE WHEN n.name = r.receiver THEN 0 WHEN n.name = concat(upper(r.receiver[1]), r.receiver[2:]) THEN 1 ELSE 2 END AS way
        FROM (SELECT DISTINCT receiver FROM s WHERE receiver IS NOT NULL) r JOIN n
        ON n.name = r.receiver OR n.name = concat(upper(r.receiver[1]), r.receiver[2:]) OR (n.kind IN ('class', 'interface', 'component') AND ends_with(lower(n.name), lower(r.receiver)))),
    kid AS (SELECT parent_id AS cand, name, min(id) AS target_id FROM n WHERE parent_id IS NOT NULL GROUP BY ALL),
    owned AS (SELECT * FROM (
        SELECT s.*, target_id, row_number() OVER (PARTITION BY source_id, ord ORDER BY CASE WHEN s.module = cm THEN 0 ELSE 1 END, way, d.cand) AS k FROM s JOIN d ON s.receiver = d.receiver JOIN kid ON kid.cand = d.cand AND kid.name = s.want) WHERE k = 1)
    SELECT source_id, c.id AS target_id, 'calls' AS kind, CAST(NULL AS VARCHAR) AS metadata, ord AS seq FROM s JOIN c ON want = c.name WHERE receiver IS NULL AND (n_name = 1 OR (s.module = c.module AND n_module = 1))
    UNION ALL SELECT source_id, target_id, 'calls', receiver, ord FROM owned
    UNION ALL SELECT s.source_id, m.id, 'calls', s.receiver, s.ord FROM s JOIN m ON want = m.name LEFT JOIN owned o ON s.source_id = o.source_id AND s.ord = o.ord
    WHERE s.receiver IS NOT NULL AND o.ord IS NULL AND (n_name = 1 OR (s.module = m.module AND n_module = 1))"""


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.renders({"nodes": _nodes(spark, sf_dir, "classes", "types"), "jsx_usages": made(spark, sf_dir, "jsx")}).select("source_id", "target_id", "kind")


RENDERS_SQL = f"""
    WITH {made_sql("classes", "types", "jsx")}, n AS (SELECT * FROM classes UNION ALL SELECT * FROM types), c AS ({_COUNTED} n)
    SELECT node_id AS source_id, c.id AS target_id, 'renders' AS kind FROM jsx JOIN n ON node_id = n.id JOIN c ON element_name = c.name
    WHERE upper(element_name[1]) = element_name[1] AND (n_name = 1 OR (n.module = c.module AND n_module = 1))"""


def graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {"nodes": _nodes(spark, sf_dir, "schema", "operations"), "graphql_resolvers": made(spark, sf_dir, "resolvers"), "annotations": made(spark, sf_dir, "entities")}
    return resolve.graphql(t).select("source_id", "target_id", "kind")


GRAPHQL_SQL = f"""
    WITH {made_sql("schema", "operations", "resolvers", "entities")},
    w AS (SELECT id, gql_operation_type AS op, unnest(gql_fields) AS field, generate_subscripts(gql_fields, 1) AS k FROM operations),
    h AS (SELECT w.id AS source_id, s.id AS target_id, s.parent_id, count(*) OVER p AS c, count(*) FILTER (WHERE s.parent_id IS NULL) OVER p AS tops FROM w JOIN schema s ON s.kind = op AND s.name = field WINDOW p AS (PARTITION BY w.id, k))
    SELECT source_id, target_id, 'gql_resolves' AS kind FROM h WHERE c = 1 OR (tops = 1 AND parent_id IS NULL)
    UNION ALL SELECT node_id, s.id, 'gql_resolves' FROM resolvers JOIN schema s ON parent_type IN ('Query', 'Mutation', 'Subscription') AND s.kind = operation_type AND s.name = field_name
    UNION ALL SELECT source_id, target_id, 'gql_resolves' FROM (
        SELECT r.node_id AS source_id, f.id AS target_id, row_number() OVER (PARTITION BY r.node_id, field_name, parent_type ORDER BY t.id, f.id) AS k
        FROM resolvers r JOIN schema t ON t.kind = 'graphql-type' AND t.name = parent_type JOIN schema f ON f.parent_id = t.id AND f.name = field_name) WHERE k = 1
    UNION ALL SELECT t.id, c.id, 'type_match' FROM schema t JOIN schema c ON c.kind = 'class' AND c.name = t.name JOIN entities e ON e.node_id = c.id WHERE t.kind = 'graphql-type' AND t.parent_id IS NULL"""


def rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.rest({"nodes": made(spark, sf_dir, "requests"), "rest_endpoints": made(spark, sf_dir, "endpoints")}).select("source_id", "target_id", "kind")


def _plain_path(column: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({column}, '/+$', ''), ':[A-Za-z0-9_]+', '{{param}}', 'g'), '\\{{[^}}]+\\}}', '{{param}}', 'g')"


REST_SQL = f"""
    WITH {made_sql("requests", "endpoints")}, c AS (SELECT id, coalesce(api_method, 'GET') AS method, {_plain_path("api_path")} AS path FROM requests WHERE api_path IS NOT NULL),
    e AS (SELECT node_id, method AS e_method, {_plain_path("path")} AS e_path FROM endpoints)
    SELECT id AS source_id, node_id AS target_id, 'rest_match' AS kind FROM c JOIN e ON (e_method = method OR e_method = 'ANY') AND (path = e_path OR starts_with(path, concat(e_path, '/')))"""


def injects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = made(spark, sf_dir, "fields").selectExpr("id", "name", "parent_id", "signature", "'field' AS kind")
    n = _nodes(spark, sf_dir, "classes", "types").unionByName(fields, allowMissingColumns=True)
    return resolve.injects({"nodes": n, "annotations": made(spark, sf_dir, "marks")}).select("source_id", "target_id", "kind", "metadata", "seq")


INJECTS_SQL = f"""
    WITH {made_sql("classes", "types", "fields", "marks")}, n AS (SELECT * FROM classes UNION ALL SELECT * FROM types),
    bean AS (SELECT * FROM n WHERE kind = 'class' AND id IN (SELECT node_id FROM marks WHERE name IN ('Service', 'Component', 'Repository'))),
    by_type AS (SELECT want, min(id) AS i FROM (SELECT id, unnest(implements_names) AS want FROM bean) GROUP BY want), by_name AS (SELECT name, min(id) AS i FROM bean GROUP BY name),
    f AS (SELECT id, parent_id, string_split(signature, ' ')[1] AS want FROM fields WHERE id IN (SELECT node_id FROM marks WHERE name IN ('Autowired', 'Inject')) AND parent_id IN (SELECT id FROM n WHERE kind = 'class' AND parent_id IS NULL))
    SELECT f.parent_id AS source_id, coalesce(t.i, b.i) AS target_id, 'injects' AS kind, f.want AS metadata, CAST(f.id AS BIGINT) AS seq FROM f LEFT JOIN by_type t ON t.want = f.want LEFT JOIN by_name b ON b.name = f.want WHERE coalesce(t.i, b.i) IS NOT NULL"""

#: name -> (query, comparison SQL)
RESOLVERS = {
    "imports": (imports, IMPORTS_SQL), "inheritance": (inheritance, INHERITANCE_SQL), "calls": (calls, CALLS_SQL), "renders": (renders, RENDERS_SQL),
    "graphql": (graphql, GRAPHQL_SQL), "rest": (rest, REST_SQL), "injects": (injects, INJECTS_SQL),
}
