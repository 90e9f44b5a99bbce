import pytest
from pyspark.sql import functions as F

from symgraph.api import Workspace
from symgraph.operators import stack
from symgraph.sources import build_files as B
from symgraph.sources import cache

POM = """<project><parent><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-parent</artifactId><version>3.2.4</version></parent>
<properties><junit.version>5.10.2</junit.version><java.version>21</java.version></properties>
<dependencyManagement><dependencies><dependency><groupId>net.tools</groupId><artifactId>pinned</artifactId><version>9</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>org.junit.jupiter</groupId><artifactId>junit-jupiter</artifactId><version>${junit.version}</version><scope>test</scope></dependency>
<dependency><groupId>org.mockito</groupId><artifactId>mockito-core</artifactId><version>5.11.0</version><scope>test</scope></dependency>
<dependency><groupId>shop.core</groupId><artifactId>price-rules</artifactId></dependency></dependencies></project>"""
GRADLE = """plugins { id("org.springframework.boot") version "3.1.5" }
java { toolchain { languageVersion.set(JavaLanguageVersion.of(17)) } }
dependencies {
  implementation 'shop.core:till:4.2'
  testImplementation("org.mockito:mockito-core:5.4.0")
  runtimeOnly "org.postgresql:postgresql:$pg"
}
"""
SBT = 'scalaVersion := "2.13.12"\nlibraryDependencies ++= Seq(\n  "com.typesafe.akka" %% "akka-stream" % "2.8.5",\n  "org.scalatest" %% "scalatest" % "3.2.18" % Test\n)\n// doobie later\n'
NPM = '{"packageManager": "pnpm@9.1.0", "dependencies": {"react": "^18.3.1", "tiny": "~2.1"}, "devDependencies": {"react": "18.2.0", "vitest": ">=1.5.0"}}'
TREE = {
    "pom.xml": POM, "till/build.gradle": GRADLE, "till/gradle/wrapper/gradle-wrapper.properties": "distributionUrl=https://services.gradle.org/distributions/gradle-8.7-bin.zip", "jobs/build.sbt": SBT, "web/package.json": NPM,
    "web/k8s/deploy.yml": "x", "web/src/schema.graphql": "type Query { a: Int }", "till/Dockerfile": "FROM x", "a/b/c/d/pom.xml": POM, "node_modules/package.json": NPM, "broken/package.json": "{",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("project")
    for path, text in TREE.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return str(base)


def test_dependencies(spark, root):
    got = {(r.path, r.artifact, r.version, r.scope) for r in B.dependencies(B.build_files(spark, root)).collect()}
    assert got == {
        ("pom.xml", "org.junit.jupiter:junit-jupiter", "5.10.2", "test"), ("pom.xml", "org.mockito:mockito-core", "5.11.0", "test"), ("pom.xml", "shop.core:price-rules", None, "compile"),
        ("till/build.gradle", "shop.core:till", "4.2", "compile"), ("till/build.gradle", "org.mockito:mockito-core", "5.4.0", "test"), ("till/build.gradle", "org.postgresql:postgresql", None, "compile"),
        ("jobs/build.sbt", "com.typesafe.akka:akka-stream", "2.8.5", "compile"), ("jobs/build.sbt", "org.scalatest:scalatest", "3.2.18", "test"),
        ("web/package.json", "react", "18.2.0", "test"), ("web/package.json", "tiny", "2.1", "compile"), ("web/package.json", "vitest", "1.5.0", "test"),
    }


def test_frameworks_of_every_module(spark, root):
    w = Workspace(spark)
    rows = w.analyze_project(root).collect()
    found = {(r.module, r.doc_key): r.version for r in rows}
    assert found == {
        ("root", "maven"): None, ("root", "spring-boot"): "3.2.4", ("root", "junit"): "5.10.2", ("root", "mockito"): "5.11.0", ("root", "java"): "21", ("root", "graphql"): None,
        ("till", "gradle"): "8.7", ("till", "spring-boot"): "3.1.5", ("till", "mockito"): "5.4.0", ("till", "postgresql"): None, ("till", "java"): "17", ("till", "docker"): None,
        ("jobs", "sbt"): None, ("jobs", "scala"): "2.13.12", ("jobs", "akka"): "2.8.5", ("jobs", "slick"): None,
        ("web", "react"): "18.2.0", ("web", "vitest"): "1.5.0", ("web", "pnpm"): "9.1.0", ("web", "kubernetes"): None, ("web", "graphql"): None,
    }
    assert {r.module: r.type for r in rows} == {"root": "backend", "till": "infra", "jobs": "backend", "web": "frontend"}
    assert {(r.module, r.doc_key): r.ord for r in rows if r.ord is not None} == {("root", "spring-boot"): 2, ("root", "junit"): 1, ("till", "spring-boot"): 2, ("till", "gradle"): 1, ("jobs", "akka"): 0, ("jobs", "scala"): 0, ("web", "react"): 2}
    assert {(r.category, r.doc_key): r.version for r in w.get_project_stack().collect()}["backend", "spring-boot"] == "3.2.4"
    keys = w.list_detected_frameworks().collect()
    assert len(keys) == keys[0].total == len({k for _, k in found}) and w.detected_version("mockito") == "5.11.0" and w.detected_version("none") is None
    used = B.used_in(w.found, spark.createDataFrame([("spring-boot",), ("react",)], "key string")).collect()
    assert {r.key: r.modules for r in used} == {"spring-boot": ["root", "till"], "react": ["web"]}


def test_a_configured_structure_stands_for_what_is_found(spark, root):
    w = Workspace(spark)
    w.configure_monorepo({"shop": ("till", "service"), "gone": ("nowhere", "shared")})
    assert {(r.module, r.path, r.type) for r in w.analyze_project(root).collect()} == {("shop", "till", "service")}
    with pytest.raises(ValueError):
        w.configure_monorepo({"x": ("y", "kitchen")})


def test_supported_frameworks(spark):
    rows = {r.key: (r.group, r.ranges) for r in B.supported_frameworks(spark, {"react": [(0, 18), (18, None)], "mine": [(None, None)]}).collect()}
    assert rows["react"] == ("Frontend", "0-17, 18-latest") and rows["mine"] == ("Other / Custom", None) and rows["vue"] == ("Frontend", "2-2, 3-latest")


def test_internal_dependencies_and_their_status(spark, root, tmp_path):
    w = Workspace(spark)
    assert w.list_internal_deps(root).count() == 0
    w.configure_internal_patterns(maven=("shop.core",))
    assert {(r.artifact, r.source_path, r.status) for r in w.list_internal_deps(root).collect()} == {("shop.core:price-rules", None, "external only"), ("shop.core:till", "till", "source found")}
    w.tables["symbols"] = spark.createDataFrame([("till",)], "module string")
    by = {r.declared_in: [(d.artifact, d.status) for d in r.deps] for r in w.internal_deps_by_module(root).collect()}
    assert by == {"pom.xml": [("shop.core:price-rules", "external only")], "till/build.gradle": [("shop.core:till", "scanned")]}


def test_version_ranges(spark):
    asked = spark.createDataFrame([("react", 17), ("akka", 2), ("akka", 9), ("vue", 1), ("junit", None), ("unknown", 3)], "key string, major int")
    got = {(r.key, r.major): (r.ord, r.min_major) for r in stack.match_versions(asked, B.version_ranges(spark)).collect()}
    assert got == {("react", 17): (1, 17), ("akka", 2): (0, 2), ("akka", 9): (1, 3), ("vue", 1): (1, 3), ("junit", None): (1, 5), ("unknown", 3): (None, None)}


def test_document_cache(spark, tmp_path):
    kind = "framework string, version string, section string, content string, fetched_at long"
    c = spark.createDataFrame([("react", "18", "a", "x", 100), ("react", "17", "a", "y", 100), ("vue", "3", "a", "z", 700_000)], kind)
    assert cache.read_live(c, F.lit(700_100)).count() == 1
    assert cache.invalidate(c, "react").count() == 1
    after = cache.write_entries(c, spark.createDataFrame([("react", "18", "a", "new", 5), ("react", "18", "b", "other", 5)], kind))
    assert {(r.version, r.section, r.content) for r in after.where("framework = 'react'").collect()} == {("18", "a", "new"), ("18", "b", "other"), ("17", "a", "y")}
    cand = spark.createDataFrame([("r", "1", "llms", "s" * 900), ("r", "1", "readme", "m" * 600), ("r", "1", "supplied", "u" * 9000), ("q", "1", "readme", "short")], "framework string, version string, source string, content string")
    assert [(r.framework, r.source) for r in cache.best_source(cand).collect()] == [("r", "readme")]
    assert [(r.framework, r.source) for r in cache.best_source(cand, cache.SUPPLY_ORDER).collect()] == [("r", "supplied")]
    folder = str(tmp_path / "store")
    cache.store_entries(c, folder)
    cache.store_entries(c.where("framework = 'vue'").withColumn("content", F.lit("later")), folder)
    assert {(r.framework, r.content) for r in spark.read.parquet(folder).collect()} == {("react", "x"), ("react", "y"), ("vue", "later")}
