"""Several modules in one graph, and trees with files and names that are hard to read."""

import os

import pytest
from pyspark.sql import functions as F

from symgraph.api import GraphNotReady, Workspace
from symgraph.sources import code
from symgraph.sources.tree import Directory, TreeReader, read_tree


def _put(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "a+b (c).d"
    _put(root, {
        "one/src/index.ts": "export function alpha() {\n  return shared()\n}\nexport function shared() {\n  return 1\n}\n",
        "two/src/index.ts": "export function gamma() {\n  return shared()\n}\nexport function shared() {\n  return 2\n}\n",
        "two/src/more.ts": "export function delta() {\n  return gamma()\n}\n",
        "two/pages/_app.tsx": "export function App() {\n  return <Nav/>\n}\n",
        "two/_components/Nav.tsx": "export function Nav() {\n  return <b>é</b>\n}\n".encode("latin-1"),
        "two/node_modules/x/index.ts": "export function lost() {}\n",
        "two/.hidden/y.ts": "export function lost() {}\n",
        "two/blank.ts": " \n",
        "two/Notes.TXT": "no source",
    })
    return root


def _names(w):
    return {(r.module, r.path, r.name) for r in w.tables["nodes"].select("id", "file_id", "name").join(w.tables["files"].select("file_id", "module", "path"), "file_id").collect()}


def _edges(w):
    n = w.tables["nodes"].join(w.tables["files"].select("file_id", F.col("module").alias("m")), "file_id").select("id", F.concat_ws("/", "m", "name").alias("name"))
    a, b = (n.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(x)) for x in "ab")
    rows = w.tables["edges"].join(a, F.col("source_id") == F.col("a_id")).join(b, F.col("target_id") == F.col("b_id")).collect()
    return {(r.kind, r.a, r.b) for r in rows}


def test_modules_with_equal_paths_stay_apart(spark, project, tmp_path):
    w = Workspace(spark).scan_modules(str(project), ["one", "./two/", "../out", "/etc"])
    wanted = {("one", "src/index.ts", "alpha"), ("one", "src/index.ts", "shared"), ("two", "src/index.ts", "gamma"), ("two", "src/index.ts", "shared"), ("two", "src/more.ts", "delta")}
    assert _names(w) == wanted | {("two", "pages/_app.tsx", "App"), ("two", "_components/Nav.tsx", "Nav")}
    assert w.tables["nodes"].select("id").distinct().count() == w.tables["nodes"].count() == 7
    assert _edges(w) == {("calls", "one/alpha", "one/shared"), ("calls", "two/gamma", "two/shared"), ("calls", "two/delta", "two/gamma"), ("renders", "two/App", "two/Nav")}
    assert [(r.module, r.message) for r in w.warnings().collect()] == [("../out", "Rejected: path escapes project root"), ("etc", "Rejected: path escapes project root")]
    detail = w.get_symbol_detail("shared", module="one").first()
    assert "return 1" in detail.source

    # One module alone is scanned again: the other keeps its rows, ids and edges.
    ids = {(r.module, r.path): r.file_id for r in w.tables["files"].collect()}
    (project / "two/src/index.ts").write_text("export function gamma() {\n  return alpha()\n}\n")
    (project / "two/src/more.ts").unlink()
    w.scan(str(project / "two"), "two")
    after = {(r.module, r.path): r.file_id for r in w.tables["files"].collect()}
    assert after == {k: v for k, v in ids.items() if k != ("two", "src/more.ts")}
    assert _edges(w) == {("calls", "one/alpha", "one/shared"), ("calls", "two/gamma", "one/alpha"), ("renders", "two/App", "two/Nav")}
    assert {r.name for r in w.symbols["two"].collect()} == {"gamma", "App", "Nav"} and {r.name for r in w.symbols["one"].collect()} == {"alpha", "shared"}
    fresh = Workspace(spark).scan_modules(str(project), ["one", "two"])
    assert _edges(fresh) == _edges(w) and _names(fresh) == _names(w)

    # What was saved is all there when it is opened again.
    w.save(str(tmp_path / "saved"))
    opened = Workspace(spark).open(str(tmp_path / "saved"))
    assert opened.module_summary("one").first().total_files == 1 and opened.get_internal_api("two").count() > 3
    opened.scan(str(project / "one"), "one")
    assert _edges(opened) == _edges(w)


def test_a_scan_without_changes_resolves_nothing(spark, project, monkeypatch):
    w = Workspace(spark).scan_modules(str(project), ["one", "two"])
    before = dict(w.tables)
    monkeypatch.setattr("symgraph.operators.resolve.resolve_all", lambda t: pytest.fail("resolved again"))
    monkeypatch.setattr("symgraph.sources.code.extract_symbols", lambda f: pytest.fail("extracted again"))
    w.scan_modules(str(project), ["one", "two"])
    assert w.tables == before and w.stale(str(project / "two"), "two").count() == 0


def test_bytes_that_are_no_text_become_marks(spark, project):
    rows = {r.file_path: r for r in code.source_files(spark, str(project / "two"), "two").collect()}
    assert set(rows) == {"src/index.ts", "src/more.ts", "pages/_app.tsx", "_components/Nav.tsx"}
    assert "<b>�</b>" in rows["_components/Nav.tsx"].text and [rows[p].file_ord for p in sorted(rows)] == [0, 1, 2, 3]


def test_filters_keep_files_closed(spark, project):
    found = read_tree(spark, str(project)).where(F.col("ending").isin("ts", "txt") & (F.col("length") < 60))
    assert {r.path for r in found.collect()} == {"two/src/more.ts", "two/blank.ts", "two/Notes.TXT", "two/node_modules/x/index.ts"}
    # The reader itself opens nothing that the filters leave out, whole directories neither.
    from pyspark.sql.datasource import In, LessThan

    reader = TreeReader({"path": str(project), "skip": '["node_modules"]'})
    assert len(list(reader.pushFilters([In(("ending",), ("ts",)), LessThan(("length",), 60)]))) == 2
    opened = [row[0] for part in reader.partitions() for row in reader._rows(part)]
    assert sorted(opened) == ["two/blank.ts", "two/src/more.ts"]
    assert read_tree(spark, str(project), content=False).where("content is not null").count() == 0


def test_what_cannot_be_read_is_a_row(spark, project, monkeypatch):
    os.symlink("/etc/passwd", project / "two/link.ts")
    os.symlink("/etc", project / "two/linked")
    assert not {r.path for r in read_tree(spark, str(project)).collect() if "link" in r.path}
    reader = TreeReader({"path": str(project), "endings": '["ts", "tsx"]'})
    part = Directory("two", 1, True)
    real = os.scandir
    (project / "two/src/more.ts").chmod(0)

    def scan(path):
        if str(path).endswith("pages"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scan)
    rows = {r[0]: r[4] for r in reader._rows(part)}
    assert rows["two/pages"] == "PermissionError: Permission denied" and rows["two/src/index.ts"] is None
    missing = read_tree(spark, str(project / "none")).collect()
    assert [(r.path, r.content) for r in missing] == [(".", None)] and missing[0].error.startswith("FileNotFoundError")


def test_warnings_are_counted_beyond_twenty(spark, project):
    with pytest.raises(GraphNotReady):
        Workspace(spark).warnings()
    w = Workspace(spark).scan_modules(str(project), [f"../m{i:02d}" for i in range(25)])
    rows = w.warnings().collect()
    assert len(rows) == 21 and rows[0].module == "../m00" and rows[-1].message == "... and 5 more"


def test_test_files_are_named_in_warnings(spark, tmp_path):
    _put(tmp_path / "m", {"package.json": '{"devDependencies": {"vitest": "1.0.0"}}', "a.ts": "export function a() {}\n", "b.ts": "import { x } from 'vitest'\nexport function b() {}\n"})
    w = Workspace(spark).scan(str(tmp_path / "m"), "m")
    assert [r.message for r in w.warnings().collect()] == ["Test frameworks detected from build file: vitest", "Skipped 1 test file(s) detected by imports/annotations"]
    assert _names(w) == {("m", "a.ts", "a")}
