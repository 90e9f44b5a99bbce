import os
import time

from pyspark.sql import functions as F

from symgraph.operators import dml, html, sections, stack
from symgraph.sources import code
from symgraph.streaming import watch

JAVA = '''package com.acme;
import com.acme.model.User;
import static org.junit.Assert.*;
/** Serves users. */
@RestController
@RequestMapping("/api")
public class UserController {
    private UserService hidden;
    @GetMapping("/users")
    public List<User> getUsers(String q) {
        String s = "not { a brace";
        return service.findAll();
    }
    @PostMapping("/users") public User create() { return service.save(make()); }
    private void secret() { }
}
'''
SCALA = '''package x
case class User(id: Int)
trait Repo {
  def find(id: Int): User = ???
}
object Main extends App {
  def run(): Unit = { repo.find(1) }
  private def hide(): Unit = ()
  val size = 3
}
'''
GRAPHQL = '''type User {
  id: ID!
  posts(first: Int): [Post]
}
input NewUser { name: String }
enum Role {
  ADMIN
}
type Query {
  users: [User]
  user(id: ID!): User
}
'''
TSX = '''import { api } from './api'
export interface Props { id: string }
export function UserList(props: Props) {
  const r = fetch(`/api/users/${props.id}`)
  client.post('/api/users', {})
  return useUsers(r)
}
export const useUsers = (x) => { return x }
function hidden() {}
'''


def _files(spark, tmp_path):
    for path, text in {"src/UserController.java": JAVA, "src/Main.scala": SCALA, "schema.graphql": GRAPHQL, "web/UserList.tsx": TSX, "node_modules/x.ts": "export const a = 1", "src/.hid/y.ts": "export const a = 1", "test/T.java": JAVA, "notes.md": "x", "blank.ts": "  \n", "big.ts": "x" * 600_000}.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)
    return code.source_files(spark, str(tmp_path), "m").cache()


def test_sources_to_symbols(spark, tmp_path):
    files = _files(spark, tmp_path)
    assert {r.file_path for r in files.collect()} == {"src/UserController.java", "src/Main.scala", "schema.graphql", "web/UserList.tsx"}
    found = code.extract_symbols(files).collect()
    name_of = {(r.file_path, r.sym_ord): r.name for r in found}
    by = {(r.language, r.kind, r.name, name_of.get((r.file_path, r.parent_ord))) for r in found}
    assert {("java", "class", "UserController", None), ("java", "method", "getUsers", "UserController"), ("java", "method", "create", "UserController")} <= by
    assert not {n for _, _, n, _ in by} & {"hidden", "secret", "hide"}
    one = {r.name: r for r in found if r.language == "java"}
    assert one["UserController"].annotations == ["@RestController", '@RequestMapping("/api")'] and one["getUsers"].annotations == ['@GetMapping("/users")'] and one["create"].annotations == ['@PostMapping("/users")']
    assert one["UserController"].doc_comment == "Serves users." and one["UserController"].package_name == "com.acme" and (one["getUsers"].start_line, one["getUsers"].end_line) == (10, 13)
    assert [(c.receiver, c.target) for c in one["getUsers"].call_sites] == [("service", "findAll")] and [(c.receiver, c.target) for c in one["create"].call_sites] == [("service", "save"), (None, "make")]
    assert {("scala", "case-class", "User", None), ("scala", "trait", "Repo", None), ("scala", "object", "Main", None), ("scala", "method", "run", "Main"), ("scala", "field", "size", "Main")} <= by
    assert {("graphql", "graphql-type", "User", None), ("graphql", "graphql-input", "NewUser", None), ("graphql", "graphql-enum", "Role", None), ("graphql", "query", "users", None), ("graphql", "query", "user", None), ("graphql", "field", "posts", "User")} <= by
    assert {("tsx", "interface", "Props", None), ("tsx", "component", "UserList", None), ("tsx", "hook", "useUsers", None)} <= by
    assert {(r.import_path) for r in code.imports_of(files).collect()} == {"com.acme.model.User", "org.junit.Assert.*", "./api"}
    assert {(r.name, r.api_method, r.api_path) for r in found if r.kind == "api-call"} == {("UserList", "GET", "/api/users/{param}"), ("UserList", "POST", "/api/users")}


def test_heading_tree(spark):
    text = "ignored\n# Main *Title*\nintro\n\nmore\n## Getting Started\n### Installation\ndo\n### Usage\n## API\n### Calls\n## End\n"
    s = sections.nest_sections(sections.split_sections(spark.createDataFrame([(1, text), (2, "flat text"), (3, None), (4, "= Ascii\nbody\n== Sub")], "id long, text string"), "id", "text")).collect()
    one = sorted((r.ord, r.title, r.section_id, r.parent_ord) for r in s if r.doc == 1)
    assert one == [(0, "Main Title", "main-title", None), (1, "Getting Started", "getting-started", 0), (2, "Installation", "installation", 1), (3, "Usage", "usage", 1), (4, "API", "api", 0), (5, "Calls", "calls", 4), (6, "End", "end", 0)]
    assert [(r.title, r.content) for r in s if r.doc == 2] == [("Overview", "flat text")]
    assert {r.title for r in s if r.doc == 4} == {"Ascii", "Sub"}
    assert html.to_markdown("<html><body><nav>x</nav><h2>T</h2><p>a <b>b</b></p><pre><code>x  y</code></pre><script>z</script></body>") == "## T\n\n\na **b**\n\n\n```\nx  y\n```"
    assert html.to_markdown(None) == ""


def test_stack_operators(spark):
    ranges = spark.createDataFrame([("react", 0, None, 17), ("react", 1, 17, 18), ("react", 2, 18, None), ("vue", 0, 2, 3)], "key string, ord int, min_major int, max_major int")
    found = spark.createDataFrame([("react", 16), ("react", 17), ("react", 40), ("react", None), ("vue", 9), ("none", 1)], "key string, major int")
    got = [(r.key, r.major, r.ord) for r in stack.match_versions(found, ranges).collect()]
    assert sorted(got, key=str) == sorted([("react", 16, 0), ("react", 17, 1), ("react", 40, 2), ("react", None, 2), ("vue", 9, 0), ("none", 1, None)], key=str)
    deps = spark.createDataFrame([("com.acme:auth-lib",), ("com.acme:data-kit",), ("x:gone",)], "artifact string")
    dirs = spark.createDataFrame([("auth-lib", "libs/auth-lib", 0), ("auth-lib", "old/auth-lib", 1), ("datakit", "libs/datakit", 2)], "name string, path string, ord int")
    assert {r.artifact: r.source_path for r in stack.source_paths(deps, dirs).collect()} == {"com.acme:auth-lib": "libs/auth-lib", "com.acme:data-kit": "libs/datakit", "x:gone": None}
    value = lambda text, *a: spark.range(1).select(stack.is_internal(F.lit(text), *a).alias("v")).first().v
    assert value("com.acme.x", ["com.acme"]) and not value("org.x", ["com.acme"]) and value("org.x", ["q"], "^org") and not value("org.x", ["q"], "(") and not value("com.acme" + "x" * 500, ["com.acme"])


def test_store_rules(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in dml.first_wins(rows, ["k"], "seq").collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in dml.last_wins(rows, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}
    assert [r.k for r in dml.unique_or_none(rows, ["k"]).collect()] == ["b"]


def test_bursts_of_a_stream(spark, tmp_path):
    src, marks = tmp_path / "events", tmp_path / "marks"
    os.makedirs(src)
    (src / "a.json").write_text("\n".join(f'{{"ts": "2024-01-01T00:00:{s:02d}Z", "path": "{p}"}}' for s, p in [(0, "A.java"), (1, "A.java"), (2, "b.ts"), (3, "skip.md"), (20, "C.scala"), (59, "late.gql")]))
    events = spark.readStream.schema("ts timestamp, path string").json(str(src))
    taken = []
    q = watch.on_each_burst(watch.debounce_stream(events), lambda df, n: taken.extend(df.collect()), str(marks), once=True)
    for _ in range(60):
        if not q.isActive:
            break
        time.sleep(1)
    assert q.exception() is None, str(q.exception())
    q.stop()
    assert [r.paths for r in sorted(taken, key=lambda r: r.start)][:2] == [["A.java", "b.ts"], ["C.scala"]]
