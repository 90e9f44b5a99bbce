"""The graph's tools as methods of one object that holds its tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions.text import extract_terms, snippet
from symgraph.operators import dml, index, ingest, modules, resolve, search, sections, stack, traversal
from symgraph.sources import build_files, cache, code, test_markers
from symgraph.storage import commit_tables, committed_tables, materialize

MODULE_TYPES = ("frontend", "backend", "service", "shared", "infra", "unknown")
SEARCHED = ["name", "qualified", "signature", "doc_comment"]


class GraphNotReady(RuntimeError):
    """Raised by graph tools before a scan."""


@dataclass(frozen=True)
class InternalPatterns:
    maven: tuple[str, ...] = ()
    npm: tuple[str, ...] = ()
    sbt: tuple[str, ...] = ()
    custom: tuple[str, ...] = ()


@dataclass
class Workspace:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    patterns: InternalPatterns = InternalPatterns()
    documents: DataFrame | None = None
    warned: DataFrame | None = None
    indexes: dict[str, DataFrame] = field(default_factory=dict)
    words: index.Index | None = None
    structure: dict[str, tuple[str, str]] | None = None
    found: DataFrame | None = None

    def _t(self) -> dict[str, DataFrame]:
        if "nodes" not in self.tables:
            raise GraphNotReady("scan sources first")
        return self.tables

    # sources and stack

    def load(self, symbols: DataFrame, imports: DataFrame | None = None, files: DataFrame | None = None) -> "Workspace":
        """Take in symbol rows and resolve all edges; files(module, file_path, text, hash) serve snippets and staleness."""
        self.tables, self.words = ingest.ingest(symbols, imports), None
        self.tables["edges"] = resolve.resolve_all(self.tables)
        self.indexes = {}
        if files is not None:
            self.tables["sources"] = files
        return self

    def scan(self, root: str, module: str, keep_tests: bool = False) -> "Workspace":
        """Read the sources below root into the graph as one module."""
        return self._scan({module: root}, [], keep_tests)

    def scan_modules(self, project: str, paths: list[str], keep_tests: bool = False) -> "Workspace":
        """Read several modules below project, each named by its path; paths that leave project are rejected with a warning."""
        named = [("/".join(x for x in p.split("/") if x not in ("", ".")) or project.rstrip("/").split("/")[-1], p) for p in paths]
        rows = self.spark.createDataFrame([(m, p) for m, p in named], "module string, path string")
        kept = {r.module for r in rows.where(code.inside(F.col("path"))).collect()}
        rejected = [(m, "Rejected: path escapes project root") for m, _ in named if m not in kept]
        return self._scan({m: f"{project.rstrip('/')}/{p}" for m, p in named if m in kept}, rejected, keep_tests)

    def _scan(self, roots: dict[str, str], rejected: list[tuple[str, str]], keep_tests: bool) -> "Workspace":
        """Take in files that are new or changed since they were last seen, and resolve edges over all of them.

        Files that give no symbols and test files are left out; a file that changed or went takes all that hung on
        it along. Where no file changed, nothing is extracted or resolved; where some did, only edges that the change can touch are made again.
        """
        texts, warned = [], [self.spark.createDataFrame([(m, 0, w) for m, w in rejected], "module string, ord int, message string")]
        for module, root in roots.items():
            files, failed = code.scanned_files(self.spark, root, module)
            texts.append(files)
            warned.append(failed.select("module", F.lit(2).alias("ord"), "message"))
        if not texts:
            self.warned = materialize(warned[0], "warnings")
            return self
        files = materialize(reduce(DataFrame.union, texts), "sources")
        names = list(roots)
        key = ["module", "file_path", "hash"]
        known = self.tables["sources"].where(F.col("module").isin(names)) if "sources" in self.tables else None
        fresh = files.join(known.select(key), key, "left_anti") if known is not None else files
        if known is not None and not fresh.limit(1).count() and not known.join(files.select(key), key, "left_anti").limit(1).count():
            self.warned = materialize(reduce(DataFrame.union, warned), "warnings")
            return self
        symbols, imports = materialize(code.extract_symbols(fresh), "scanned"), code.imports_of(fresh)
        if not keep_tests:
            tests = []
            for module, root in roots.items():
                deps = build_files.dependencies(build_files.build_files(self.spark, root).where("path not like '%/%'"))
                markers = test_markers.detect_markers(deps)
                mine = F.col("module") == module
                tests.append(materialize(test_markers.test_files(symbols.where(mine), imports.where(mine), markers).select("module", "file_path"), "tests"))
                listed = markers.where(F.size("frameworks") > 0).select(F.concat(F.lit("Test frameworks detected from build file: "), F.array_join("frameworks", ", ")))
                skipped = tests[-1].agg(F.count("*").alias("n")).where("n > 0").select(F.concat(F.lit("Skipped "), F.col("n"), F.lit(" test file(s) detected by imports/annotations")))
                warned += [rows.toDF("message").select(F.lit(module).alias("module"), F.lit(i).alias("ord"), "message") for i, rows in ((1, listed), (3, skipped))]
            symbols = materialize(symbols.join(reduce(DataFrame.union, tests), ["module", "file_path"], "left_anti"), "scanned")
        stored = self.tables.get("files")
        new = ingest.ingest(symbols, imports, fresh, stored.select("module", "path", "file_id") if stored is not None else None)
        sources, taken = files.select("module", "file_path", "text", "hash"), fresh.select("module", F.col("file_path").alias("path"))
        if stored is not None:
            seen = files.select("module", F.col("file_path").alias("path"), "hash")
            gone = materialize(stored.where(F.col("module").isin(names)).join(seen, ["module", "path", "hash"], "left_anti").select("file_id"), "gone")
            if self.words is not None:
                self.words.remove(self.tables["nodes"].join(gone, "file_id", "left_semi")).add(new["nodes"])
            new = ingest.merge({k: v for k, v in self.tables.items() if k != "symbols"}, gone, new)
        if known is not None:
            sources = materialize(self.tables["sources"].where(~F.col("module").isin(names)).select(sources.columns).union(sources), "sources")
        if "symbols" in self.tables:
            still = files.select("module", "file_path").join(fresh.select("module", "file_path"), ["module", "file_path"], "left_anti")
            kept = self.tables["symbols"].where(F.col("module").isin(names)).join(still, ["module", "file_path"], "left_semi")
            others = self.tables["symbols"].where(~F.col("module").isin(names))
            symbols = materialize(reduce(DataFrame.union, [x.select(symbols.columns) for x in (others, kept, symbols)]), "module-symbols")
        tables = new | {"sources": sources, "symbols": symbols}
        if stored is not None and "edges" in self.tables:
            came = tables["files"].join(taken, ["module", "path"], "left_semi").select("file_id")
            tables["edges"] = resolve.resolve_changes(tables, self.tables["edges"], self.tables, gone, materialize(came, "came"))
        else:
            tables["edges"] = resolve.resolve_all(tables)
        self.tables, self.indexes = tables, {}  # whoever reads meanwhile sees the tables before or after
        self.warned = materialize(reduce(DataFrame.union, warned), "warnings")
        return self

    def warnings(self, most: int = 20) -> DataFrame:
        """(module, message): what the last scan could not read, rejected or left out, the first `most` of it and how many more."""
        if self.warned is None:
            raise GraphNotReady("scan sources first")
        first = self.warned.orderBy("module", "ord", "message").limit(most)
        more = self.warned.agg((F.count("*") - most).alias("n")).where("n > 0")
        more = more.select(F.lit(None).cast("string").alias("module"), F.lit(9).alias("ord"), F.concat(F.lit("... and "), F.col("n"), F.lit(" more")).alias("message"))
        return first.union(more).orderBy(F.col("module").asc_nulls_last(), "ord", "message").select("module", "message")

    def _modules(self) -> list[str]:
        """Names of the scanned modules, those without symbols too; a project has some hundreds at most."""
        named = [self.tables[t].select("module") for t in ("sources", "symbols") if t in self.tables]
        return sorted(r.module for r in reduce(DataFrame.union, named).distinct().collect()) if named else []

    @property
    def symbols(self) -> dict[str, DataFrame]:
        """Symbol rows of each scanned module."""
        return {m: self._symbols_of(m) for m in self._modules()}

    def save(self, root: str) -> str:
        """Write all tables as one version below root; readers see all of it or nothing."""
        held = {f"index_{k}": v for k, v in self.words.tables.items()} if self.words is not None else {}
        return commit_tables(self.spark, self._t() | held, root)

    def open(self, root: str) -> "Workspace":
        found = committed_tables(self.spark, root)
        held = {k.removeprefix("index_"): v for k, v in found.items() if k.startswith("index_")}
        self.tables, self.indexes = {k: v for k, v in found.items() if not k.startswith("index_")}, {}
        self.words = index.Index.opened(self.spark, "id", SEARCHED, held) if held else None
        return self

    def _symbols_of(self, module: str) -> DataFrame:
        if "symbols" not in self.tables:
            raise GraphNotReady("scan sources first")
        return self.tables["symbols"].where(F.col("module") == module)

    def module_summary(self, module: str) -> DataFrame:
        """Counts, type names, annotations, endpoints, entities and events of a scanned module."""
        symbols = self._symbols_of(module)
        return modules.summaries(symbols, symbols.select("module", "file_path").distinct())

    def get_internal_api(self, module: str) -> DataFrame:
        """A scanned module as documentation sections, in reading order."""
        symbols = self._symbols_of(module)
        return modules.in_order(modules.doc_sections(symbols, symbols.select("module", "file_path", "language").distinct())).orderBy("n")

    def configure_monorepo(self, structure: dict[str, tuple[str, str]]) -> None:
        """{module: (path, type)}: what analyze_project looks at instead of what it finds."""
        wrong = [t for _, t in structure.values() if t not in MODULE_TYPES]
        if wrong:
            raise ValueError(f"module types are {', '.join(MODULE_TYPES)}, not {wrong[0]}")
        self.structure = dict(structure)

    def analyze_project(self, root: str) -> DataFrame:
        """Frameworks of each module with the documented version range that fits (ord, min_major, max_major)."""
        self.found = materialize(build_files.analyze(self.spark, root, self.structure), "stack")
        rows = self.found.withColumn("key", F.col("doc_key")).withColumn("major", F.regexp_extract("version", "^(\\d+)", 1).try_cast("int"))
        return stack.match_versions(rows, build_files.version_ranges(self.spark))

    def _stack(self) -> DataFrame:
        if self.found is None:
            raise GraphNotReady("analyze a project first")
        return self.found

    def get_project_stack(self) -> DataFrame:
        """(category, name, version, doc_key) over all modules, each key once in a category."""
        return build_files.stack_by_category(self._stack())

    def list_detected_frameworks(self) -> DataFrame:
        return build_files.distinct_frameworks(self._stack())

    def detected_version(self, key: str) -> str | None:
        return self._stack().agg(build_files.detected_version(key).alias("v")).first().v

    def configure_internal_patterns(self, **lists: tuple[str, ...]) -> None:
        """Replace the lists given; others stay."""
        self.patterns = replace(self.patterns, **lists)

    def list_internal_deps(self, root: str) -> DataFrame:
        """Dependencies that match the patterns, with the source directory that carries their name and whether it was scanned."""
        files = build_files.build_files(self.spark, root)
        deps = build_files.dependencies(files)
        parts = [("maven", self.patterns.maven), ("gradle", self.patterns.maven), ("npm", self.patterns.npm), ("sbt", self.patterns.sbt)]
        inside = F.lit(False)
        for eco, prefixes in parts:
            if prefixes:
                inside = inside | ((F.col("ecosystem") == eco) & stack.is_internal(F.col("artifact"), list(prefixes)))
        for pattern in self.patterns.custom:
            inside = inside | stack.is_internal(F.col("artifact"), ["\0"], pattern)
        # A directory comes after those above it and after the branches that sort ahead of it.
        dirs = files.where("path like '%/%'").select(F.element_at(F.split("path", "/"), -2).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("ord", F.split("path", "/"))
        found = dml.keep_one(deps.where(inside), ["artifact", "path"], [F.col("version").isNull(), F.col("version")])
        out = stack.source_paths(found.withColumnRenamed("path", "declared_in"), dirs)
        scanned = F.array(*[F.lit(m) for m in self._modules()]).cast("array<string>")
        known = F.exists(scanned, lambda m: (F.col("source_path") == m) | F.endswith(F.col("source_path"), F.concat(F.lit("/"), m)))
        return out.withColumn("status", F.when(F.col("source_path").isNull(), "external only").when(known, "scanned").otherwise("source found"))

    def internal_deps_by_module(self, root: str) -> DataFrame:
        """(declared_in, deps): the internal dependencies of each build file with their status."""
        deps = self.list_internal_deps(root)
        return deps.groupBy("declared_in").agg(F.array_sort(F.collect_list(F.struct("artifact", "version", "ecosystem", "status"))).alias("deps"))

    def source_symbols(self, root: str, module: str) -> DataFrame:
        return code.extract_symbols(code.source_files(self.spark, root, module))

    # graph

    def graph_status(self) -> DataFrame:
        t = self._t()
        count = lambda name: t[name].agg(F.count("*").alias(f"total_{name}"))
        last = t["files"].agg((F.max("scanned_at") if "scanned_at" in t["files"].columns else F.lit(None).cast("long")).alias("last_scan"))
        return count("files").crossJoin(count("nodes")).crossJoin(count("edges")).crossJoin(last)  # one row each

    def stale(self, root: str, module: str) -> DataFrame:
        """(path, status) of a module's files that changed or went since they were scanned."""
        now = code.source_files(self.spark, root, module).select(F.col("file_path").alias("path"), "hash")
        return dml.stale_files(self._t()["files"].where(F.col("module") == module), now)

    def _named(self, name: str, module: str | None = None) -> DataFrame:
        return search.named(self._t()["nodes"], name, module=module)

    def _index(self) -> index.Index:
        """The index of the nodes, made at the first search; later scans add segments to it."""
        if self.words is None:
            self.words = index.Index.build(self._t()["nodes"], "id", SEARCHED)
        return self.words

    def search_symbols(self, query: str, kind: str | None = None, module: str | None = None, limit: int = 20) -> DataFrame:
        n = self._t()["nodes"]
        where: Column = F.lit(True)
        where = where & (F.col("kind") == kind) if kind else where
        where = where & (F.col("module") == module) if module else where
        found = self._index().search(query, limit, n.where(where).select("id") if kind or module else None)
        rows = found.join(n.select("id", "name", "qualified", "kind", "file_id", "start_line", "module", "signature"), "id")
        return rows.join(self._t()["files"].select("file_id", F.col("path").alias("file_path")), "file_id", "left").orderBy("rank", "id")

    def get_symbol_detail(self, name: str, module: str | None = None) -> DataFrame:
        t = self._t()
        n = self._named(name, module)
        gather = lambda df, key, cols, out: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
        out = n
        wanted = n.select(F.col("id").alias("wanted"))  # the symbols of one name; only their rows are gathered
        for df, key, cols, alias in (
            (t["annotations"], "node_id", ["name", "value"], "notes"), (t["rest_endpoints"], "node_id", ["method", "path"], "endpoints"), (t["nodes"], "parent_id", ["start_line", "name", "kind"], "children"),
            (t["edges"], "source_id", ["kind", "target_id"], "edges_out"), (t["edges"], "target_id", ["kind", "source_id"], "edges_in"),
        ):
            out = out.join(gather(df.join(wanted, F.col(key) == F.col("wanted"), "left_semi"), key, cols, alias), "id", "left")
        return self._with_source(out)

    def _with_source(self, rows: DataFrame) -> DataFrame:
        if "sources" not in self.tables:
            return rows
        texts = self.tables["sources"].select("module", F.col("file_path").alias("path"), "text").join(self.tables["files"].select("file_id", "module", "path"), ["module", "path"])
        return rows.join(texts.select("file_id", "text"), "file_id", "left").withColumn("source", snippet(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")

    def _seeds(self, name: str, module: str | None) -> DataFrame:
        return self._named(name, module).select(F.col("id").alias("node"))

    def _steps(self, reverse: bool) -> DataFrame:
        """Edges by where they start, or end, written at the first traversal after a scan."""
        name = "steps_in" if reverse else "steps_out"
        if name not in self.indexes:
            self.indexes[name] = traversal.step_index(self._t()["edges"], reverse)
        return self.indexes[name]

    def _visited(self, found: DataFrame) -> DataFrame:
        """Visited nodes as the tools show them, in visit order."""
        t = self._t()
        nodes = t["nodes"].select(F.col("id").alias("node"), "name", F.col("kind").alias("node_kind"), "file_id", F.col("start_line").alias("line"))
        rows = found.join(nodes, "node").join(t["files"].select("file_id", F.col("path").alias("file")), "file_id", "left")
        return rows.select("node", "depth", "edge_kind", "parent", "visit_ord", "name", F.col("node_kind").alias("kind"), "file", "line").orderBy("visit_ord")

    def get_callers(self, name: str, depth: int = 2, module: str | None = None) -> DataFrame:
        return self._visited(traversal.visits(self._steps(True), self._seeds(name, module), depth, traversal.CALLS))

    def get_callees(self, name: str, depth: int = 2, module: str | None = None) -> DataFrame:
        return self._visited(traversal.visits(self._steps(False), self._seeds(name, module), depth, traversal.CALLS))

    def get_impact(self, name: str, depth: int = 3, module: str | None = None) -> DataFrame:
        children = self._t()["nodes"].where("parent_id is not null").select("parent_id", F.col("id").alias("node"))
        return self._visited(traversal.visits(self._steps(True), traversal.with_children(self._seeds(name, module), children), depth))

    def build_context(self, task: str, max_nodes: int = 20) -> DataFrame:
        """Symbols around the best search hits for a task's words."""
        t = self._t()
        terms = self.spark.range(1).select(extract_terms(F.lit(task)).alias("t")).first().t
        found = self._index().search(" OR ".join(x.replace("-", " ") for x in terms), 10)
        ranked = found.select(F.col("id").alias("node"), (F.row_number().over(Window.orderBy("rank", "id")) - 1).alias("seed_rank"))  # ten rows at most
        nodes = t["nodes"].select(F.col("id").alias("node"), "name", "kind", "module")
        return traversal.build_context(nodes, t["edges"], ranked, t["rest_endpoints"].select(F.col("node_id").alias("node")), max_nodes)

    # documents

    def resolve_documents(self, candidates: DataFrame) -> "Workspace":
        """Take the best source of each framework's documents and split it into sections."""
        best = cache.best_source(candidates).withColumn("doc", F.concat_ws(":", "framework", "version"))
        self.documents = sections.nest_sections(sections.split_sections(best, "doc", "content"))
        return self

    def get_doc_index(self, framework: str, version: str) -> DataFrame:
        return self.documents.where(F.col("doc") == f"{framework}:{version}").select("ord", "level", "title", "section_id", "summary", "parent_ord").orderBy("ord")

    def get_doc_section(self, framework: str, section_id: str, version: str) -> DataFrame:
        return sections.section_map(self.documents.where(F.col("doc") == f"{framework}:{version}")).where(F.col("section_id") == section_id)

    def fetch_external_docs(self, framework: str, version: str) -> DataFrame:
        return sections.full_document(self.documents.where(F.col("doc") == f"{framework}:{version}"))
