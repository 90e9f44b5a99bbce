import pytest
from pyspark.sql import functions as F

from symgraph.functions import text as X
from symgraph.operators import dml, ingest, resolve, search, traversal
from symgraph.schema import SYMBOLS


def symbol(name, kind, children=(), **more):
    return {"name": name, "kind": kind, "children": children, **more}


def rows_of(module, files, language="java"):
    """Flatten nested symbols of {path: (package, [symbols])} in pre-order."""
    out = []
    for file_ord, (path, (package, symbols)) in enumerate(files.items()):
        count = 0

        def walk(s, parent):
            nonlocal count
            me = count
            count += 1
            base = {"module": module, "file_path": path, "language": language, "package_name": package, "file_ord": file_ord, "sym_ord": me, "parent_ord": parent, "visibility": "public", "start_line": me + 1, "end_line": me + 9}
            out.append({**{f.name: None for f in SYMBOLS}, **base, **{k: v for k, v in s.items() if k != "children"}})
            for child in s["children"]:
                walk(child, me)

        for s in symbols:
            walk(s, None)
    return out


def graph(spark, rows, imports=()):
    symbols = spark.createDataFrame([tuple(r[f.name] for f in SYMBOLS) for r in rows], SYMBOLS)
    tables = ingest.ingest(symbols, spark.createDataFrame(list(imports), "module string, file_path string, import_path string"))
    tables["edges"] = resolve.resolve_all(tables)
    return tables


def edges(t):
    names = t["nodes"].select("id", "name")
    e = t["edges"].join(names.toDF("source_id", "source"), "source_id").join(names.toDF("target_id", "target"), "target_id")
    return {(r.source, r.kind, r.target, r.metadata) for r in e.collect()}


def call(target, receiver=None):
    return {"target": target, "receiver": receiver}


@pytest.fixture(scope="module")
def chain(spark):
    rows = rows_of("api", {
        "a/Controller.java": ("com.acme", [symbol("Controller", "class", [symbol("handlePost", "method", call_sites=[call("createUser", "service")])])]),
        "a/AdminController.java": ("com.acme", [symbol("AdminController", "class", [symbol("handleAdmin", "method", call_sites=[call("createUser", "service")])])]),
        "a/Service.java": ("com.acme", [symbol("Service", "class", [symbol("createUser", "method", call_sites=[call("save", "repository")])], doc_comment="Handles user business logic")]),
        "a/Repository.java": ("com.acme", [symbol("Repository", "class", [symbol("save", "method")])]),
    })
    return graph(spark, rows, [("api", "a/Controller.java", "com.acme.Service"), ("api", "a/Controller.java", "java.util.List"), ("api", "a/AdminController.java", "com.acme.*"), ("api", "a/Repository.java", "./Service")])


def seeds(t, name):
    return t["nodes"].where(F.col("name") == name).select(F.col("id").alias("node"))


def names(t, reached):
    return {r.name: r.depth for r in reached.join(t["nodes"].select(F.col("id").alias("node"), "name"), "node").collect()}


def test_call_chain(chain):
    t = chain
    assert ("handlePost", "calls", "createUser", "service") in edges(t) and ("createUser", "calls", "save", "repository") in edges(t)
    assert set(names(t, traversal.callers(t["edges"], seeds(t, "createUser"), 1))) == {"handlePost", "handleAdmin"}
    assert names(t, traversal.callers(t["edges"], seeds(t, "save"), 2)) == {"createUser": 1, "handlePost": 2, "handleAdmin": 2}
    assert not names(t, traversal.callers(t["edges"], seeds(t, "handlePost"), 2))
    assert names(t, traversal.callees(t["edges"], seeds(t, "handlePost"), 2)) == {"createUser": 1, "save": 2}
    children = t["nodes"].where("parent_id is not null").select("parent_id", F.col("id").alias("node"))
    reached = traversal.impact(t["edges"], seeds(t, "Service"), 3, children)
    assert "Controller" in names(t, reached)
    counts = traversal.impact_counts(reached).first()
    assert counts.direct_count > 0 and counts.transitive_count >= counts.direct_count


def test_imports(chain):
    got = {(s, t) for s, k, t, _ in edges(chain) if k == "imports"}
    assert ("Controller", "Service") in got and {("AdminController", x) for x in ("Controller", "Service", "Repository")} <= got
    assert not any(s == "Repository" for s, _ in got)


def test_relative_imports_try_suffixes_in_order(spark):
    t = graph(spark, rows_of("web", {"src/a/x.ts": (None, [symbol("X", "function")]), "src/b.ts": (None, [symbol("B", "function")]), "src/b/index.ts": (None, [symbol("C", "function")]), "src/a/y.js": (None, [])}, "typescript"),
              [("web", "src/a/x.ts", "../b"), ("web", "src/b.ts", "./a/none"), ("web", "src/b/index.ts", "../a/./x")])
    assert {(s, d) for s, k, d, _ in edges(t) if k == "imports"} == {("X", "B"), ("C", "X")}
    assert t["nodes"].where("name = 'X'").first().qualified == "src/a/x.ts#X"


def test_cross_language_chain(spark):
    rows = rows_of("web", {"q.ts": (None, [symbol("GET_USERS", "gql-operation", gql_operation_type="query", gql_fields=["users"])]),
                           "u.tsx": (None, [symbol("UserList", "component", call_sites=[call("useQuery")], jsx_elements=["Card", "div"]), symbol("Card", "component"), symbol("useQuery", "hook")])}, "typescript")
    rows += rows_of("schema", {"s.graphql": (None, [symbol("users", "query"), symbol("User", "graphql-type", [symbol("users", "field"), symbol("posts", "field")]), symbol("posts", "query")])}, "graphql")
    rows += rows_of("api", {
        "UserResolver.java": ("x", [symbol("UserResolver", "class", [symbol("users", "method", annotations=["@DgsQuery"], call_sites=[call("findAll", "userService")]), symbol("feed", "method", annotations=['@DgsData(parentType = "User", field = "posts")'])])]),
        "UserService.java": ("x", [symbol("UserService", "class", [symbol("findAll", "method", call_sites=[call("findAll", "repository")]), symbol("repo", "field", signature="UserRepository repo", annotations=["@Autowired"])])]),
        "UserRepository.java": ("x", [symbol("UserRepository", "interface", [symbol("findAll", "method")])]),
        "Impl.java": ("x", [symbol("UserRepositoryImpl", "class", annotations=["@Repository"], implements_names=["UserRepository"])]),
        "User.java": ("x", [symbol("User", "class", annotations=["@Entity"])]),
    })
    got = edges(graph(spark, rows))
    assert ("GET_USERS", "gql_resolves", "users", None) in got and ("users", "gql_resolves", "users", None) in got and ("feed", "gql_resolves", "posts", None) in got
    assert ("User", "type_match", "User", None) in got and ("UserList", "calls", "useQuery", None) in got
    assert {(s, d) for s, k, d, _ in got if k == "renders"} == {("UserList", "Card")}
    assert ("UserService", "injects", "UserRepositoryImpl", "UserRepository") in got and ("UserRepositoryImpl", "implements", "UserRepository", None) in got
    assert ("findAll", "calls", "findAll", "repository") in got and ("users", "calls", "findAll", "userService") in got


def test_rest_composition_and_matching(spark):
    rows = rows_of("api", {"C.java": ("x", [symbol("C", "class", [symbol("getUser", "method", annotations=['@GetMapping("/{id}")']), symbol("create", "method", annotations=["@PostMapping"]), symbol("data", "method", annotations=['@RequestMapping("/data")'])], annotations=['@RequestMapping("/api/users/")'])]),
                           "D.java": ("x", [symbol("D", "class", [symbol("any", "method", annotations=['@RequestMapping("/data")'])])])})
    rows += rows_of("web", {"c.ts": (None, [symbol("one", "api-call", api_method="GET", api_path="/api/users/:id"), symbol("put", "api-call", api_method="PUT", api_path="/data/x"), symbol("bare", "api-call", api_path="/api/userstats"), symbol("post", "api-call", api_method="POST", api_path="/api/users")])}, "typescript")
    t = graph(spark, rows)
    ends = {(r.method, r.path) for r in t["rest_endpoints"].collect()}
    assert ends == {("GET", "/api/users/{id}"), ("POST", "/api/users"), ("ANY", "/api/users/data"), ("ANY", "/data")}
    assert {(s, d) for s, k, d, _ in edges(t) if k == "rest_match"} == {("one", "getUser"), ("put", "any"), ("post", "create")}


def test_ambiguity_inheritance_and_cycles(spark):
    rows = rows_of("a", {"A.java": ("p", [symbol("ClassA", "class", extends_name="ClassB", implements_names=["Shared", "Nowhere"]), symbol("ClassB", "class", extends_name="ClassA"), symbol("Shared", "interface"), symbol("go", "function", call_sites=[call("twice")])]), "B.java": ("p", [symbol("twice", "function"), symbol("twice", "method", start_line=50)])})
    rows += rows_of("b", {"B.java": ("q", [symbol("Shared", "interface"), symbol("lonely", "function", call_sites=[call("twice"), call("twice", "ghost")])])})
    got = edges(graph(spark, rows))
    assert ("ClassA", "extends", "ClassB", None) in got and ("ClassB", "extends", "ClassA", None) in got and ("ClassA", "implements", "Shared", None) in got
    assert not any(s == "go" for s, *_ in got)
    assert {(s, m) for s, k, d, m in got if d == "twice"} == {("lonely", "ghost")}


def test_depth_is_capped(spark):
    e = spark.createDataFrame([(i, i + 1, "calls") for i in range(50)], "source_id long, target_id long, kind string")
    assert traversal.callees(e, spark.createDataFrame([(0,)], "node long"), 50).count() == 10


def test_seeds_block_each_other(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b")], "source_id string, target_id string").withColumn("kind", F.lit("calls"))
    got = {r.node: (r.depth, r.seed_rank) for r in traversal.expand_seeds(e, spark.createDataFrame([("a", 0), ("b", 1), ("x", 2)], "node string, seed_rank int")).collect()}
    assert got == {"a": (0, 0), "b": (1, 0), "c": (2, 0), "x": (2, 0)}


def test_ingest_twice_changes_nothing_and_changed_files_cascade(spark, chain):
    n = chain["nodes"]
    again = dml.last_wins(n.union(n), ["file_id", "name", "kind", "start_line"], "id")
    assert again.count() == n.count()
    doomed = chain["files"].where("path like '%Service%'").select("file_id")
    left = dml.delete_files({k: chain[k] for k in ("nodes", "edges", "call_sites", "files")}, doomed)
    assert left["files"].count() == 3 and left["nodes"].where("name in ('Service', 'createUser')").count() == 0
    gone = {r.id for r in n.join(doomed, "file_id", "left_semi").collect()}
    assert all(r.source_id not in gone and r.target_id not in gone for r in left["edges"].collect())
    assert dml.delete_edges_by_kind(chain["edges"], []).count() == chain["edges"].count()
    stale = dml.stale_files(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string"), spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string"))
    assert {(r.path, r.status) for r in stale.collect()} == {("b", "changed"), ("c", "deleted")}


def test_search_and_queries(spark, chain):
    cols = ["name", "qualified", "signature", "doc_comment"]
    found = search.search(chain["nodes"], "business logic", "id", cols).join(chain["nodes"].select("id", "name"), "id").collect()
    assert [r.name for r in found] == ["Service"]
    for hostile in ("*", "name:*", '"unbalanced', "AND OR NOT", "([{", "", "OR OR", "---"):
        search.search(chain["nodes"], hostile, "id", cols).collect()
    assert search.sanitize_query('OR a* OR OR "b c" OR') == [["a"], ["b", "c"]]
    assert search.parse_query("Élan fn_50 OR --") == [[("elan",), ("fn", "50")]]
    index = search.postings(chain["nodes"], "id", cols)
    changed = chain["nodes"].where("name = 'Service'").withColumn("doc_comment", F.lit("new words"))
    after = search.refresh_postings(index, changed, "id", cols)
    assert after.where("term = 'business'").count() == 0 and after.where("term = 'words'").count() == 1


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    for raw, want in [("/users/:id", "/users/{param}"), ("/users/{id}", "/users/{param}"), ("/api/users", "/api/users"), ("/api/users/", "/api/users")]:
        assert value(X.normalize_path(F.lit(raw))) == want
    assert value(X.extract_terms(F.lit("fix the login endpoint"))) == ["login", "endpoint"]
    for raw, want in [('@GetMapping("/api/users")', "/api/users"), ('@DgsData(parentType = "Query", field = "users")', "users"), ("@Override", None), ('@RequestMapping({"/a", "/b"})', "/a")]:
        assert value(X.annotation_value(F.lit(raw))) == want
    for url, ok in [("https://docs.github.com/x", True), ("http://user@github.com:443/x", True), ("ftp://github.com", False), ("https://evilgithub.com", False), ("https://github.com.evil.org", False), ("nonsense", False), ("https://127.0.0.1", False)]:
        assert value(X.host_allowed(F.lit(url))) is ok, url
    assert value(X.last_segments(F.lit("a/b/c/d"), 2)) == "c/d" and value(X.last_segments(F.lit("a"), 2)) == "a"
    assert [value(X.time_ago(F.lit(s).cast("long"))) for s in (1, 60, 7200, 90000)] == ["1 seconds ago", "1 minute ago", "2 hours ago", "1 day ago"]
    assert value(X.parse_major(F.lit("^3.2.1"))) == 3 and value(X.parse_major(F.lit("latest"))) is None
    assert value(X.json_texts(F.lit('["a","b"]'))) == ["a", "b"] and value(X.json_texts(F.lit("oops"))) is None
