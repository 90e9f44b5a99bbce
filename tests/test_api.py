import pytest
from test_code_graph import call, rows_of, symbol

from symgraph.api import GraphNotReady, Workspace
from symgraph.schema import SYMBOLS


def test_tools_over_a_small_graph(spark):
    empty = Workspace(spark)
    with pytest.raises(GraphNotReady):
        empty.graph_status()
    rows = rows_of("api", {
        "Controller.java": ("com.acme", [symbol("Controller", "class", [symbol("handleLogin", "method", annotations=['@PostMapping("/login")'], call_sites=[call("login", "service")])])]),
        "Service.java": ("com.acme", [symbol("Service", "class", [symbol("login", "method")], doc_comment="Checks login attempts")]),
    })
    symbols = spark.createDataFrame([tuple(r[f.name] for f in SYMBOLS) for r in rows], SYMBOLS)
    sources = spark.createDataFrame([("api", "Service.java", "one\ntwo\nthree")], "module string, file_path string, text string")
    w = empty.load(symbols, files=sources)
    assert w.graph_status().first().total_nodes == 4
    assert {r.name for r in w.search_symbols("login").collect()} == {"login", "Service"}
    assert [r.name for r in w.search_symbols("login", kind="class").collect()] == ["Service"]
    detail = w.get_symbol_detail("login").first()
    assert [e.kind for e in detail.edges_in] == ["calls"] and detail.source == "two\nthree"
    assert w.get_callers("login").count() == 1 and w.get_impact("Service").count() >= 1
    context = w.build_context("fix the login endpoint").collect()
    assert context[0].name in ("Service", "login") and {"Service", "login", "handleLogin"} <= {r.name for r in context}
    docs = spark.createDataFrame([("react", "18", "llms", "# A\n" + "x" * 1200 + "\n## B\nbody")], "framework string, version string, source string, content string")
    w.resolve_documents(docs)
    assert [r.title for r in w.get_doc_index("react", "18").collect()] == ["A", "B"]
    assert w.get_doc_section("react", "b", "18").first().content == "body"
    assert w.fetch_external_docs("react", "18").first().content.endswith("## B\n\nbody")
