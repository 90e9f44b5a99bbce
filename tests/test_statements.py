"""Extraction over statements: declarations that share lines or span them, nested types, calls inside parentheses."""

import pytest

from symgraph.operators import ingest
from symgraph.sources import code

JAVA = """package shop;

/**
 * Serves orders.
 */
@RestController
@RequestMapping(
    value = "/outer",
    produces = {"a(b", "c)"}
)
public class Outer<T extends Map<String, List<T>>>
        extends Base<T>
        implements Priced,
        Sold {
    @Autowired private Port port; @Inject protected Clock clock; int a; int b;

    /** Lists. */
    @GetMapping(
        path = "/list"
    )
    @Deprecated
    public List<T> list(
        @Param("x)") String x,
        int y
    ) throws IOException {
        run(() -> { inner.one(x); two(); });
        return new ArrayList<>();
    }

    static class Nested {
        public void hidden() { gone(); }
    }

    enum Level { LOW, HIGH }

    interface Made { void make(); }

    @PostMapping("/add") public void add() { three(); } void tail() { four(); }
}
class Second { void m() { one(); } }
enum Third { A, B(1), C; int w() { return 1; } }
@interface Fourth { String value(); }
"""
TSX = """export const load = async ({ id, all }: { id: string; all?: boolean }) => {
  await fetch(`/a/${id}`); await fetch('/b')
  return typeof id === 'string' && (await rest.get('/c'))
}
export function Page({ rows }: Props) {
  useEffect(() => {
    fetch('/d')
    for (const r of (rows)) { api.post('/e', { body: r }) }
  }, [])
  return <Table rows={rows}><Row key={1}/></Table>
}
export class Store { private secret() { lost() } put(x) { return save(x) } get size() { return 1 }
  find = (x) => x; }
export interface Shape { kind: string; area(): number }
export enum Tone { Low = 'l', High }
const local = () => { hidden() }
export default Page
"""
SCHEMA = "type Query { order(id: ID!,\n  all: Boolean): Order }\ntype Order { id: ID! name: String }\ninput Asked { id: ID! }\n"


@pytest.fixture(scope="module")
def rows(spark):
    files = [("m", "Outer.java", "java", JAVA), ("m", "page.tsx", "tsx", TSX), ("m", "s.graphql", "graphql", SCHEMA), ("m", "none.java", "java", None), ("m", "open.java", "java", "class Open { void m( {\n")]
    df = spark.createDataFrame([(*f, i) for i, f in enumerate(files)], "module string, file_path string, language string, text string, file_ord int")
    return code.extract_symbols(df).collect()


def of(rows, path):
    return {(r.kind, r.name): r for r in rows if r.file_path == path}


def test_declarations_of_one_line_and_of_several(rows):
    got = of(rows, "Outer.java")
    assert set(got) == {
        ("class", "Outer"), ("field", "clock"), ("field", "a"), ("field", "b"), ("method", "list"), ("method", "add"), ("method", "tail"),
        ("class", "Second"), ("method", "m"), ("enum", "Third"), ("constant", "A"), ("constant", "B"), ("constant", "C"), ("method", "w"), ("annotation", "Fourth"), ("method", "value"),
    }
    outer = got["class", "Outer"]
    assert outer.annotations == ["@RestController", '@RequestMapping( value = "/outer", produces = {"a(b", "c)"} )'] and outer.doc_comment == "Serves orders."
    assert (outer.extends_name, outer.implements_names, outer.start_line, outer.end_line) == ("Base", ["Priced", "Sold"], 11, 39)
    listed = got["method", "list"]
    assert listed.annotations == ['@GetMapping( path = "/list" )', "@Deprecated"] and listed.doc_comment == "Lists." and (listed.start_line, listed.end_line) == (22, 28)
    assert [(c.receiver, c.target) for c in listed.call_sites] == [(None, "run"), ("inner", "one"), (None, "two")]
    assert got["field", "clock"].annotations == ["@Inject"] and got["field", "a"].annotations == []
    assert got["method", "add"].annotations == ['@PostMapping("/add")'] and [c.target for c in got["method", "add"].call_sites] == ["three"] and [c.target for c in got["method", "tail"].call_sites] == ["four"]
    second = got["class", "Second"]
    assert (second.start_line, second.end_line) == (40, 40) and got["method", "m"].parent_ord == second.sym_ord and [c.target for c in got["method", "m"].call_sites] == ["one"]
    assert got["constant", "B"].parent_ord == got["enum", "Third"].sym_ord == got["method", "w"].parent_ord


def test_paths_of_annotations_over_lines(spark, rows):
    t = ingest.ingest(spark.createDataFrame(rows, code.SYMBOLS))
    served = t["rest_endpoints"].join(t["nodes"].selectExpr("id as node_id", "name"), "node_id").collect()
    assert {(r.name, r.method, r.path) for r in served} == {("list", "GET", "/outer/list"), ("add", "POST", "/outer/add")}


def test_calls_inside_parentheses_and_words_that_are_none(rows):
    got = of(rows, "page.tsx")
    calls = lambda kind, name: [(c.receiver, c.target) for c in got[kind, name].call_sites]
    assert calls("function", "load") == [(None, "fetch"), (None, "fetch"), ("rest", "get")]
    assert calls("component", "Page") == [(None, "useEffect"), (None, "fetch"), ("api", "post")] and set(got["component", "Page"].jsx_elements) == {"Table", "Row"}
    assert [(r.name, r.api_method, r.api_path, r.start_line) for r in rows if r.kind == "api-call"] == [("load", "GET", "/a/{param}", 2), ("load", "GET", "/b", 2), ("load", "GET", "/c", 3), ("Page", "GET", "/d", 7), ("Page", "POST", "/e", 8)]
    assert {k for k in got if k[0] != "api-call"} == {
        ("function", "load"), ("component", "Page"), ("class", "Store"), ("method", "put"), ("method", "size"), ("field", "find"), ("interface", "Shape"), ("field", "kind"), ("method", "area"), ("enum", "Tone"), ("constant", "Low"),
    }
    assert (got["class", "Store"].start_line, got["class", "Store"].end_line) == (12, 13) and (got["function", "load"].start_line, got["function", "load"].end_line) == (1, 4)


def test_schemas_on_single_lines(rows):
    assert set(of(rows, "s.graphql")) == {("query", "order"), ("graphql-type", "Order"), ("field", "id"), ("graphql-input", "Asked")}


def test_open_brackets_do_no_harm(rows):
    assert set(of(rows, "open.java")) == {("class", "Open")} and not of(rows, "none.java")
