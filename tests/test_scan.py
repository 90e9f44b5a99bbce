import shutil

import pytest
from pyspark.sql import functions as F

from symgraph.api import Workspace
from symgraph.operators import modules
from symgraph.sources import code, documents, test_markers
from symgraph.storage import commit_tables, committed_tables

TREE = {
    "shop/OrderPort.java": "package shop;\n\npublic interface OrderPort {\n    Order byNumber(String number);\n}\n",
    "shop/Order.java": "package shop;\n@Entity\npublic class Order extends Base<String> implements java.io.Serializable, Priced<Money> {\n    private long number;\n    protected String note = \"}\";\n}\n",
    "shop/OrderStore.java": """package shop;

import shop.model.*;
import shop.Order;

/**
 * Keeps orders { in memory }.
 * Second line.
 */
@Service
public class OrderStore implements OrderPort {
    /* a comment
       that goes } on
    */
    public OrderStore(Clock clock) { this.clock = clock; }

    public Order byNumber(
            String number,
            int limit) {
        audit.record(number);
        return new Order(find(number));
    }

    private Order find(String number) { return null; }

    enum State { A }
}
""",
    "shop/OrderController.java": """package shop;

@RestController
@RequestMapping("/orders")
public class OrderController {
    @Autowired
    OrderPort port;

    @GetMapping("/{number}")
    public Order show(String number) {
        return orderStore.byNumber(number, 1);
    }

    @DgsQuery
    public Order order(String number) { return show(number); }
}
""",
    "shop/Level.java": "package shop;\npublic enum Level {\n    LOW, HIGH(2);\n    int weight() { return 1; }\n}\n",
    "shop/OrderStoreTest.java": "package shop;\nimport org.junit.jupiter.api.Test;\npublic class OrderStoreTest {\n    @Test\n    void works() { }\n}\n",
    "api/schema.graphql": '# orders by number\ntype Query {\n  "one order"\n  order(number: String): Order\n}\n\ntype Order {\n  number: String\n}\n',
    "web/OrderPage.tsx": """import { useOrder } from './useOrder'
import Row from './Row'

export const GET_ORDER = gql`
  query GetOrder {
    order {
      number
    }
  }
`

export function OrderPage(props: { id: string }) {
  const order = useOrder(props.id)
  return <Row value={order}><b>x</b></Row>
}
""",
    "web/useOrder.ts": "export const useOrder = (id: string) => {\n  return loadOrder(id).then(parse)\n}\nfunction loadOrder(id) {\n  return fetch(`/orders/${id}`)\n}\n",
    "web/Row.tsx": "function Row(p) {\n  // it's a row\n  return <div>{p.value}</div>\n}\nexport default Row\nclass Hidden {\n  secretMethod() { return 1 }\n}\nexport { Row as Other }\n",
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root, Workspace(spark).scan(str(root), "shop")


def _edges(w):
    n = w.tables["nodes"].select("id", "name", "kind")
    a, b = (n.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name"), F.col("kind").alias(f"{x}_kind")) for x in "ab")
    rows = w.tables["edges"].join(a, F.col("source_id") == F.col("a_id")).join(b, F.col("target_id") == F.col("b_id")).collect()
    return {(r.kind, r.a_name, r.b_name) for r in rows}


def test_a_tree_of_three_languages_becomes_edges(scanned):
    edges = _edges(scanned[1])
    assert {
        ("implements", "OrderStore", "OrderPort"), ("imports", "OrderStore", "Order"), ("calls", "show", "byNumber"), ("calls", "order", "show"), ("injects", "OrderController", "OrderStore"),
        ("rest_match", "loadOrder", "show"), ("gql_resolves", "GET_ORDER", "order"), ("gql_resolves", "order", "order"), ("type_match", "Order", "Order"), ("renders", "OrderPage", "Row"),
        ("calls", "OrderPage", "useOrder"), ("imports", "GET_ORDER", "Row"), ("imports", "GET_ORDER", "useOrder"),
    } <= edges, edges
    assert not {n for _, a, b in edges for n in (a, b)} & {"find", "secretMethod", "Hidden", "OrderStoreTest", "works"}


def test_symbols_of_the_tree(scanned):
    rows = scanned[1].symbols["shop"].collect()
    by = {(r.file_path.split("/")[-1], r.kind, r.name): r for r in rows}
    store = by["OrderStore.java", "class", "OrderStore"]
    assert store.doc_comment == "Keeps orders { in memory }.\nSecond line." and store.annotations == ["@Service"] and (store.start_line, store.end_line) == (11, 27)
    assert {(r.kind, r.name) for r in rows if r.file_path.endswith("OrderStore.java")} == {("class", "OrderStore"), ("constructor", "OrderStore"), ("method", "byNumber")}
    method = by["OrderStore.java", "method", "byNumber"]
    assert method.parent_ord == store.sym_ord and [(c.receiver, c.target) for c in method.call_sites] == [("audit", "record"), (None, "find")]
    order = by["Order.java", "class", "Order"]
    assert (order.extends_name, order.implements_names) == ("Base", ["Serializable", "Priced"]) and by["Order.java", "field", "note"].visibility == "protected"
    assert {r.name for r in rows if r.kind == "constant" and r.file_path.endswith("Level.java")} == {"LOW", "HIGH"}
    assert by["schema.graphql", "query", "order"].doc_comment == "one order" and by["schema.graphql", "query", "order"].parent_ord is None
    operation = by["OrderPage.tsx", "gql-operation", "GET_ORDER"]
    assert (operation.gql_operation_type, operation.gql_fields) == ("query", ["order"])
    assert set(by["OrderPage.tsx", "component", "OrderPage"].jsx_elements) == {"Row", "b"} and ("Row.tsx", "component", "Row") in by


def test_a_second_scan_takes_up_what_changed(scanned, spark, tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(scanned[0], root)
    w = Workspace(spark).scan(str(root), "shop")
    ids = {r.path: r.file_id for r in w.tables["files"].collect()}
    (root / "shop/Level.java").unlink()
    (root / "shop/Order.java").write_text("package shop;\n@Entity\npublic class Order { public int total() { return 1; } }\n")
    (root / "shop/New.java").write_text("package shop;\npublic class New { int x() { return order.total(); } }\n")
    assert {(r.path, r.status) for r in w.stale(str(root), "shop").collect()} == {("shop/Level.java", "deleted"), ("shop/Order.java", "changed")}
    w.scan(str(root), "shop")
    after = {r.path: r.file_id for r in w.tables["files"].collect()}
    assert set(after) == set(ids) - {"shop/Level.java"} | {"shop/New.java"} and all(after[p] == ids[p] for p in set(after) & set(ids))
    assert after["shop/New.java"] not in ids.values()
    fresh = Workspace(spark).scan(str(root), "shop")
    assert _edges(w) == _edges(fresh) and w.tables["nodes"].count() == fresh.tables["nodes"].count()
    assert w.graph_status().first().last_scan > 0
    version = w.save(str(tmp_path / "saved"))
    assert version and Workspace(spark).open(str(tmp_path / "saved")).tables["edges"].count() == w.tables["edges"].count()


def test_commits_replace_each_other_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    assert committed_tables(spark, root) == {}
    for k in (1, 2):
        commit_tables(spark, {"a": spark.range(k), "b": spark.range(k)}, root)
    assert {n: t.count() for n, t in committed_tables(spark, root).items()} == {"a": 2, "b": 2}


def test_module_summary_and_sections(scanned):
    w = scanned[1]
    s = w.module_summary("shop").first()
    assert {"Order", "OrderStore", "OrderController"} <= set(s.public_classes) and s.public_interfaces == ["OrderPort", "Order"][: len(s.public_interfaces)]
    assert s.entities == ["Order"] and {"@Service", "@Entity", "@GetMapping"} <= set(s.annotations)
    assert [(e.method, e.path, e.handler) for e in s.rest_endpoints] == [("GET", "/{number}", "OrderController.show")]
    rows = w.get_internal_api("shop").collect()
    assert rows[0].id == "shop-overview" and rows[0].summary.startswith(f"{s.total_files} files, {s.total_symbols} symbols | ") and " | 1 REST endpoints | 1 entities" in rows[0].summary
    text = {r.title: r.summary for r in rows}
    assert text["class: OrderStore"] == "Keeps orders { in memory }." and text["GET /{number}"] == "Handler: OrderController.show"
    ids = {r.id for r in rows}
    assert all(r.parent_id in ids for r in rows if r.parent_id)


def test_markers_of_test_files(spark):
    deps = spark.createDataFrame([("org.mockito:mockito-core", "test"), ("vitest", "test"), ("junit", "compile")], "artifact string, scope string")
    m = test_markers.detect_markers(deps)
    row = m.first()
    assert row.frameworks == ["mockito-core", "vitest"] and row.imports == ["org.mockito", "vitest"] and "@Mock" in row.annotations and "@Test" not in row.annotations
    imports = spark.createDataFrame([("m", "a.ts", "vitest/config"), ("m", "b.ts", "react")], "module string, file_path string, import_path string")
    symbols = spark.createDataFrame([("m", "c.java", "class C", ["@Mock(x)"]), ("m", "d.java", "class D", ["@Test"]), ("m", "e.scala", "class E extends AnyFunSuite", None), ("m", "f.java", None, [])], "module string, file_path string, signature string, annotations array<string>")
    assert {r.file_path for r in test_markers.test_files(symbols, imports, m).collect()} == {"a.ts", "c.java"}
    fallback = test_markers.detect_markers(deps.limit(0))
    assert fallback.first().frameworks == [] and {r.file_path for r in test_markers.test_files(symbols, imports, fallback).collect()} == {"a.ts", "c.java", "d.java", "e.scala"}


def test_paths_that_leave_the_root(spark):
    paths = ["a/b", "a/../b", "../a", "a/../../b", "/a", "C:\\a", "./a", "a/..", ".."]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", code.inside(F.col("p")).alias("v")).collect()
    assert [r.p for r in got if r.v] == ["a/b", "a/../b", "./a", "a/.."]


def test_tree_index(spark):
    rows = [("d", 0, 1, "A", "a", "first", None), ("d", 1, 2, "B", "b", None, 0), ("d", 2, 3, "C", "c", "third", 1)]
    sections = spark.createDataFrame(rows, "doc string, ord long, level int, title string, section_id string, summary string, parent_ord long")
    lines = [r.text for r in modules.tree_lines(sections).orderBy("ord").collect()]
    assert lines == ["- **A** [`a`]\n  first", "  - **B** [`b`]\n    ", "    - **C** [`c`]\n      third"]


def test_documents_take_their_sources_in_order(spark):
    readme = "https://raw.githubusercontent.com/acme/kit/master/README.md"
    nested = "https://raw.githubusercontent.com/acme/kit/master/docs/README.md"
    page = "<html><body><h2>Guide</h2>" + "<p>Supplied text of the guide.</p>" * 60 + "</body></html>"
    landed = spark.createDataFrame([(readme, "docs/README.md"), (nested, "# Kit\n" + "nested text " * 100), ("https://react.dev/learn", page), ("https://evil.example/x", page), ("https://nextjs.org/llms.txt", "# L\n" + "l" * 900)], "url string, text string")
    docs = documents.Documents(spark, landed, builtin={"kit": [documents.Entry("Kit 1", "acme/kit", max_major=2), documents.Entry("Kit 2", "acme/kit", "https://nextjs.org/llms.txt", 2)]})
    assert docs.landed.count() == 4 and docs.describe("kit", "^1.4") == "Kit 1" and docs.describe("kit") == "Kit 2" and docs.describe("none") is None
    assert docs.ensure("kit", "1.0").startswith("# Kit") and docs.ensure("kit", "2.0").startswith("# Kit")  # llms.txt is too short to be asked for
    docs.landed = docs.landed.limit(0)
    assert docs.ensure("kit", "1.0", now=100).startswith("# Kit") and docs.ensure("kit", "1.0", now=8 * 86400) is None
    assert "Kit 1" in docs.needs_url("kit", "1.0") and docs.needs_url("x").startswith("No documents of x are known (x documentation)")
    docs.landed = documents.landed_texts(landed)
    assert [r.title for r in docs.supply_url("kit", "https://react.dev/learn", "1.0").collect()] == ["Guide"] and docs.resolved_url("kit", "1.0") == "https://react.dev/learn"
    assert docs.disk.where("version = '1.0'").count() == 2 and docs.disk.where("version = '2.0'").count() == 0
    assert docs.add_framework("own", documents.Entry("two", min_major=2)) == 1 and docs.add_framework("own", documents.Entry("one", min_major=0, max_major=2)) == 2
    assert docs.available() == ["kit", "own"] and docs.describe("own", "1.2") == "one" and docs.remove_framework("own") and not docs.remove_framework("own")
    assert docs.resolved_url("own") is None and docs.sections("own").count() == 0
