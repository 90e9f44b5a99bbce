"""Frameworks, dependencies and test markers read out of build files with column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.functions.text import clean_version
from symgraph.operators.dml import keep_one
from symgraph.operators.stack import prefer_versioned
from symgraph.sources.tree import read_tree
from symgraph.storage import materialize

# Build files looked for, and how deep; directories passed over.
MARKERS = {"package.json": "npm", "pom.xml": "maven", "build.gradle.kts": "gradle", "build.gradle": "gradle", "build.sbt": "sbt"}
MAX_DEPTH = 3
PASSED_OVER = ["node_modules", "target", "build", "dist"]

# Fixed values: (name, category, key of its documents, expression over the build file's text, properties that hold its version, expression whose group 1 is its version).
MAVEN = [
    ("maven", "build", "maven", "", [], None),
    ("spring-boot", "backend", "spring-boot", "(?i)spring-boot", ["spring-boot.version", "spring.boot.version"], "spring-boot[^<]*?(\\d+\\.\\d+\\.\\d+)"),
    ("spring-data-jpa", "backend", "spring-data-jpa", "(?i)spring-data-jpa", [], None),
    ("spring-data-mongodb", "database", "spring-data-mongodb", "(?i)spring-data-mongodb", [], None),
    ("spring-security", "backend", "spring-security", "(?i)spring-security", ["spring-security.version"], None),
    ("hibernate", "backend", "hibernate", "(?i)hibernate-core|hibernate-entitymanager", ["hibernate.version"], "hibernate[^<]*?(\\d+\\.\\d+\\.\\d+)"),
    ("graphql-java", "api", "graphql-java", "(?i)graphql-java(?!-)", [], None),
    ("netflix-dgs", "api", "netflix-dgs", "(?i)dgs-framework|com\\.netflix\\.graphql\\.dgs", [], None),
    ("mysql", "database", "mysql", "(?i)mysql-connector", [], None),
    ("mongodb", "database", "mongodb", "(?i)mongodb-driver|mongo-java-driver|spring-data-mongodb", [], None),
    ("postgresql", "database", "postgresql", "(?i)postgresql|org\\.postgresql", [], None),
    ("junit", "testing", "junit", "(?i)junit-jupiter|junit-bom", ["junit-jupiter.version", "junit.version"], "junit[^<]*?(\\d+\\.\\d+\\.\\d+)"),
    ("mockito", "testing", "mockito", "(?i)mockito", [], None),
    ("lombok", "other", "lombok", "(?i)lombok", [], None),
    ("spring-webflux", "backend", "spring-framework", "(?i)spring-webflux", [], None),
    ("redis", "database", "redis", "(?i)jedis|lettuce|spring-data-redis", [], None),
    ("google-adk", "backend", "google-adk", "(?i)com\\.google\\.adk|google-adk", [], None),
]
GRADLE = [
    ("gradle", "build", "gradle", "", [], None),
    ("spring-boot", "backend", "spring-boot", "org\\.springframework\\.boot|spring-boot", [], "org\\.springframework\\.boot['\":\\s)]+version\\s*(?:=\\s*)?['\"]?(\\d+\\.\\d+\\.\\d+)"),
    ("spring-data-jpa", "backend", "spring-data-jpa", "spring-data-jpa", [], None),
    ("spring-data-mongodb", "database", "spring-data-mongodb", "spring-data-mongodb", [], None),
    ("spring-security", "backend", "spring-security", "spring-security", [], None),
    ("hibernate", "backend", "hibernate", "hibernate", [], None),
    ("graphql-java", "api", "graphql-java", "graphql-java(?!-)", [], None),
    ("netflix-dgs", "api", "netflix-dgs", "com\\.netflix.*dgs|dgs-framework", [], None),
    ("mysql", "database", "mysql", "mysql", [], None),
    ("mongodb", "database", "mongodb", "mongodb", [], None),
    ("postgresql", "database", "postgresql", "org\\.postgresql", [], None),
    ("junit", "testing", "junit", "junit-jupiter|junit-bom", [], None),
    ("mockito", "testing", "mockito", "mockito", [], None),
    ("lombok", "other", "lombok", "lombok", [], None),
    ("google-adk", "backend", "google-adk", "com\\.google\\.adk|google-adk", [], None),
]
SBT = [
    ("sbt", "build", "sbt", "", [], None),
    ("scala", "backend", "scala", "", [], "scalaVersion\\s*:=\\s*\"(\\d+\\.\\d+\\.\\d+)\""),
    ("akka", "backend", "akka", "(?i)akka", [], None),
    ("play", "backend", "play", "(?i)com\\.typesafe\\.play|playframework", [], None),
    ("sangria", "api", "sangria", "(?i)sangria", [], None),
    ("cats", "backend", "cats", "(?i)typelevel.*cats|cats-core", [], None),
    ("zio", "backend", "zio", "(?i)dev\\.zio|zio-", [], None),
    ("mongodb", "database", "mongodb", "(?i)reactivemongo|org\\.mongodb", [], None),
    ("slick", "database", "slick", "(?i)slick|doobie|quill", [], None),
]
# Fixed values: (category, key of the documents where it is not the package's name, packages).
NPM = [
    ("frontend", None, ["react", "react-dom"]), ("frontend", None, ["redux", "@reduxjs/toolkit"]), ("frontend", None, ["vue"]), ("frontend", None, ["next"]), ("frontend", "angular", ["angular", "@angular/core"]), ("frontend", None, ["svelte"]),
    ("api", None, ["graphql"]), ("api", "@apollo/client", ["@apollo/client", "apollo-client"]), ("api", None, ["relay-runtime"]), ("api", None, ["urql"]), ("build", None, ["typescript"]), ("build", None, ["vite"]), ("build", None, ["webpack"]),
    ("frontend", None, ["tailwindcss"]), ("backend", None, ["express"]), ("backend", None, ["fastify"]), ("backend", "nestjs", ["@nestjs/core"]), ("testing", None, ["jest"]), ("testing", None, ["vitest"]), ("testing", None, ["cypress"]),
    ("testing", "playwright", ["playwright", "@playwright/test"]), ("database", None, ["mongoose"]), ("database", "prisma", ["@prisma/client", "prisma"]), ("database", None, ["typeorm"]), ("database", None, ["sequelize"]),
    ("api", None, ["axios"]), ("api", None, ["swr"]), ("api", None, ["@tanstack/react-query"]), ("backend", "langchain-js", ["langchain", "@langchain/core", "@langchain/openai"]), ("backend", "langgraph", ["@langchain/langgraph"]),
]
# Fixed values: (name, category, key of its documents, files in a module's directory, directories in it).
INFRA = [
    ("docker", "container", "docker", ["Dockerfile"], []), ("docker-compose", "container", "docker", ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"], []),
    ("kubernetes", "orchestration", "kubernetes", [], ["k8s", "kubernetes"]), ("helm", "orchestration", "helm", ["Chart.yaml"], ["helm"]),
]
# Documented ranges of major versions, the lower bound in it, the upper one not.
RANGES = {
    "react": [(0, 17), (17, 18), (18, 19), (19, None)], "@apollo/client": [(2, 3), (3, None)], "next": [(0, 13), (13, 15), (15, None)], "vue": [(2, 3), (3, None)], "tailwindcss": [(0, 4), (4, None)],
    "spring-boot": [(1, 2), (2, 3), (3, None)], "spring-framework": [(4, 5), (5, 6), (6, None)], "spring-data-jpa": [(2, 3), (3, None)], "spring-security": [(5, 6), (6, None)], "hibernate": [(4, 5), (5, 6), (6, None)],
    "junit": [(4, 5), (5, None)], "akka": [(2, 3), (3, None)], "play": [(2, 3), (3, None)], "scala": [(2, 3), (3, None)], "zio": [(1, 2), (2, None)], "mysql": [(5, 8), (8, None)], "helm": [(2, 3), (3, None)],
    "gradle": [(7, 8), (8, None)], "yarn": [(1, 2), (2, None)],
}
# What a listing shows a framework under; anything else is under OTHER.
GROUPS = {
    "Frontend": ["react", "redux", "@reduxjs/toolkit", "graphql", "@apollo/client", "next", "vue", "angular", "vite", "typescript", "tailwindcss"],
    "Backend (Java)": ["spring-boot", "spring-framework", "spring-data-jpa", "spring-data-mongodb", "spring-security", "hibernate", "junit", "mockito", "lombok", "graphql-java", "netflix-dgs"],
    "Backend (Scala)": ["akka", "play", "scala", "sbt", "cats", "zio", "sangria"],
    "Databases": ["mongodb", "mysql", "postgresql", "redis"], "Containers": ["docker", "kubernetes", "helm"], "Build Tools": ["maven", "gradle", "yarn", "npm"],
}
OTHER = "Other / Custom"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, dir, name) of all files below root, relative to it; "." is root itself. Hidden and passed-over directories are left out; no file is opened."""
    rows = read_tree(spark, root, PASSED_OVER, content=False).where("error is null")
    return rows.select("path", _dir("path").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))


def build_files(spark: SparkSession, root: str, wrappers: bool = False) -> DataFrame:
    """(path, name, ecosystem, text) of build files at most MAX_DEPTH directories below root, and of Gradle's wrapper properties if asked."""
    names = [*MARKERS, "gradle-wrapper.properties"] if wrappers else list(MARKERS)
    found = read_tree(spark, root, ["node_modules", "target", "build", "dist"], names=names).where("error is null")
    rows = found.withColumn("name", F.element_at(F.split("path", "/"), -1))
    kind = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[F.col("name")]
    wrapper = F.col("path").rlike("(^|/)gradle/wrapper/gradle-wrapper\\.properties$") & F.lit(wrappers)
    rows = rows.where((F.col("name").isin(list(MARKERS)) & (F.size(F.split("path", "/")) <= MAX_DEPTH + 1)) | wrapper)
    return rows.select("path", "name", kind.alias("ecosystem"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, artifact, version, scope): group:name, or the package's name; managed Maven versions are left out.

    A version that names a property is looked up in the file; what stays a reference is null.
    """
    maven = files.where("ecosystem = 'maven'").withColumn("body", F.regexp_replace("text", "(?s)<dependencyManagement>.*?</dependencyManagement>", ""))
    block = maven.select("path", "ecosystem", "text", F.explode(F.regexp_extract_all("body", F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.regexp_extract("d", f"<{t}>\\s*([^<]+?)\\s*</{t}>", 1)
    named = F.regexp_extract(tag("version"), "^\\$\\{(.+)\\}$", 1)
    properties = F.regexp_extract_all("text", F.lit("<([\\w.-]+)>[^<>]+</[\\w.-]+>"), F.lit(0))
    looked = F.regexp_extract(F.get(F.filter(properties, lambda p: F.startswith(p, F.concat(F.lit("<"), named, F.lit(">")))), F.lit(0)), ">([^<]+)<", 1)
    version = F.when(named != "", looked).otherwise(tag("version"))
    a = block.select("path", "ecosystem", F.concat(tag("groupId"), F.lit(":"), tag("artifactId")).alias("artifact"), F.when(version != "", version).alias("version"), F.when(tag("scope") != "", tag("scope")).otherwise("compile").alias("scope"))

    gradle = files.where("ecosystem = 'gradle'").select("path", "ecosystem", F.explode(F.regexp_extract_all("text", F.lit("(?m)^\\s*(\\w+)[\\s(]+(?:platform\\()?[\"']([^\"':]+:[^\"':]+(?::[^\"']+)?)[\"']"), F.lit(0))).alias("d"))
    parts = F.split(F.regexp_extract("d", "[\"']([^\"']+)[\"']", 1), ":")
    last = F.get(parts, F.lit(2))
    b = gradle.select("path", "ecosystem", F.concat(parts[0], F.lit(":"), parts[1]).alias("artifact"), F.when(~F.startswith(last, F.lit("$")), last).alias("version"), F.when(F.col("d").rlike("^\\s*test"), "test").otherwise("compile").alias("scope"))

    sbt = files.where("ecosystem = 'sbt'").select("path", "ecosystem", F.explode(F.regexp_extract_all("text", F.lit("\"[^\"]+\"\\s*%%?%?\\s*\"[^\"]+\"\\s*%\\s*[^,\\n)]+"), F.lit(0))).alias("d"))
    quoted = F.regexp_extract_all("d", F.lit("\"([^\"]+)\""), F.lit(1))
    c = sbt.select("path", "ecosystem", F.concat(quoted[0], F.lit(":"), quoted[1]).alias("artifact"), F.get(quoted, F.lit(2)).alias("version"), F.when(F.col("d").rlike("%\\s*\"?[Tt]est\"?\\s*$"), "test").otherwise("compile").alias("scope"))

    npm = files.where("ecosystem = 'npm'").withColumn("j", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>"))
    sections = [npm.select("path", "ecosystem", F.explode(F.col(f"j.{s}")).alias("artifact", "v"), F.lit(scope).alias("scope")) for s, scope in (("dependencies", "compile"), ("devDependencies", "test"))]
    e = sections[1].union(sections[0].join(sections[1].select("path", "artifact"), ["path", "artifact"], "left_anti").select(sections[1].columns))
    e = e.select("path", "ecosystem", "artifact", F.regexp_replace("v", "^[\\^~>=<\\s]+", "").alias("version"), "scope")
    return reduce(DataFrame.union, [a, b, c, e])


def _by_text(files: DataFrame, ecosystem: str, rules: list, extra: Column) -> DataFrame:
    """Frameworks whose expression the text of a build file holds, with the version that the rule, or extra, reads from it."""
    spark = files.sparkSession
    kind = "ord int, name string, category string, doc_key string, pattern string, held array<string>, version_pattern string"
    table = F.broadcast(spark.createDataFrame([(i, *rule) for i, rule in enumerate(rules)], kind))  # a dozen rules, always
    hit = files.where(F.col("ecosystem") == ecosystem).withColumnRenamed("name", "source").join(table, F.expr("text rlike pattern"))
    block = F.regexp_extract("text", "(?s)<properties>(.*?)</properties>", 1)
    known = F.transform(F.regexp_extract_all(block, F.lit("<([a-zA-Z0-9._-]+)>[^<]+</\\1>"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "<([^>]+)>", 1).alias("k"), F.trim(F.regexp_extract(x, ">([^<]+)<", 1)).alias("v")))
    held = F.flatten(F.transform("held", lambda name: F.filter(known, lambda x: x["k"] == name)))
    found = F.when(F.col("version_pattern").isNotNull(), F.expr("regexp_extract(text, version_pattern, 1)"))
    version = F.coalesce(F.get(held, F.lit(0))["v"], F.when(found != "", found), F.when(F.col("pattern") != "", extra))
    return hit.select("path", "ord", "name", "category", version.alias("version"), "source", "doc_key")


def _first_version(texts: Column, pattern: str) -> Column:
    """Group 1 of the first text that has one, without range marks."""
    hits = F.filter(F.transform(texts, lambda t: F.regexp_extract(t, pattern, 1)), lambda v: v != "")
    return clean_version(F.get(hits, F.lit(0)))


def detected(files: DataFrame, others: DataFrame) -> DataFrame:
    """(dir, rank, name, category, version, source, doc_key): what the build files and the listing `others` say of each directory.

    files are rows of build_files() (and of wrapper properties, for Gradle's own version).
    rank is the order of detection within a directory.
    """
    blocks = F.regexp_extract_all(F.regexp_replace("text", "(?s)<dependencyManagement>.*?</dependencyManagement>", ""), F.lit("(?s)<dependency>.*?</dependency>"), F.lit(0))
    parent = clean_version(F.regexp_extract("text", "(?s)<parent>.*?spring-boot-starter-parent.*?<version>([^<]+)</version>", 1))
    own = _first_version(F.filter(blocks, lambda d: F.regexp_like(d, F.col("pattern"))), "<version>([^<$]+)</version>")
    maven = _by_text(files, "maven", MAVEN, F.coalesce(own, F.when((F.col("name") == "spring-boot") & (parent != ""), parent)))
    java = lambda pattern: F.when(F.regexp_extract("text", pattern, 1) != "", F.regexp_extract("text", pattern, 1))
    compiled = F.coalesce(*[java(f"(?s)<properties>.*?<{p}>\\s*([^<]+?)\\s*</{p}>") for p in ("java\\.version", "maven\\.compiler\\.source", "maven\\.compiler\\.target")])
    toolchain = java("(?:sourceCompatibility|jvmTarget|java\\.toolchain\\.languageVersion|languageVersion)\\s*(?:=|\\.set\\()\\s*['\"]?(?:JavaLanguageVersion\\.of\\()?(\\d+)")
    javas = files.where(F.col("ecosystem").isin("maven", "gradle")).select("path", F.lit(99).alias("ord"), F.lit("java").alias("name"), F.lit("build").alias("category"), F.when(F.col("ecosystem") == "maven", compiled).when(F.col("ecosystem") == "gradle", toolchain).alias("version"), F.col("name").alias("source"), F.lit("java").alias("doc_key")).where("version is not null")

    both = files.where("ecosystem = 'gradle'").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    one = both.groupBy("dir").agg(F.max("path").alias("path"))  # the Kotlin script where there are two
    scripts = both.join(one.select("path"), "path", "left_semi").drop("dir")
    quoted = F.regexp_extract_all("text", F.lit("['\"][^'\"\\n]*['\"]"), F.lit(0))
    gradle = _by_text(scripts, "gradle", GRADLE, _first_version(F.filter(quoted, lambda q: F.regexp_like(q, F.col("pattern"))), ":(\\d+\\.\\d+\\.\\d+[^'\"]*?)['\"]"))
    wrappers = files.where("name = 'gradle-wrapper.properties'").select(F.regexp_replace("path", "/?gradle/wrapper/[^/]*$", "").alias("at"), F.regexp_extract("text", "gradle-(\\d+\\.\\d+(?:\\.\\d+)?)", 1).alias("wrapper"))
    gradle = gradle.join(wrappers, F.regexp_replace("path", "/?[^/]*$", "") == F.col("at"), "left").withColumn("version", F.when(F.col("name") == "gradle", F.col("wrapper")).otherwise(F.col("version"))).drop("at", "wrapper")

    triples = F.regexp_extract_all("text", F.lit("\"[^\"]+\"\\s*%%?\\s*\"[^\"]+\"\\s*%\\s*\"[^\"]+\""), F.lit(0))
    named = F.filter(triples, lambda t: F.regexp_like(F.regexp_replace(t, "^\"([^\"]+)\"\\s*%%?\\s*\"([^\"]+)\".*$", "$1:$2"), F.col("pattern")))
    sbt = _by_text(files, "sbt", SBT, F.regexp_extract(F.get(named, F.lit(0)), "\"([^\"]+)\"$", 1)).withColumn("version", F.when(F.col("version") != "", F.col("version")))

    targets = [(i, n, category, key or n) for i, (category, key, n) in enumerate((c, k, n) for c, k, names in NPM for n in names)]
    npm_rules = F.broadcast(files.sparkSession.createDataFrame(targets, "ord int, name string, category string, doc_key string"))
    npm = files.where("ecosystem = 'npm'").where(F.get_json_object("text", "$").isNotNull()).select("path", F.col("name").alias("source"), F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>, packageManager string").alias("j"))
    asked = F.coalesce(F.expr("j.devDependencies[name]"), F.expr("j.dependencies[name]"))
    packages = npm.crossJoin(npm_rules).where(asked != "").select("path", "ord", "name", "category", clean_version(asked).alias("version"), "source", "doc_key")
    locks = others.where("name = 'yarn.lock'").select(F.col("dir").alias("lock_dir"))
    field = F.regexp_extract("j.packageManager", "^(\\w+)@(.+)$", 1)
    managers = npm.withColumn("d", _dir("path")).join(locks, F.col("d") == F.col("lock_dir"), "left")
    manager = F.when(F.coalesce(field, F.lit("")) != "", field).when(F.col("lock_dir").isNotNull(), "yarn").otherwise("npm")
    pinned = F.regexp_extract("j.packageManager", "^(\\w+)@(.+)$", 2)
    managers = managers.select("path", F.lit(98).alias("ord"), manager.alias("name"), F.lit("build").alias("category"), F.when(pinned != "", pinned).alias("version"), "source", manager.alias("doc_key"))

    stage = F.create_map(*[F.lit(x) for kv in {"package.json": 0, "pom.xml": 1, "build.gradle.kts": 2, "build.gradle": 2, "build.sbt": 3}.items() for x in kv])[F.col("source")]
    rows = reduce(DataFrame.union, [maven, javas, gradle, sbt, packages, managers])
    return rows.select(_dir("path").alias("dir"), F.struct(stage.alias("stage"), "ord").alias("rank"), "name", "category", "version", "source", "doc_key")


def _dir(path: str) -> Column:
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(folder == "", ".").otherwise(folder)


def _above(others: DataFrame) -> DataFrame:
    """(above, below, depth, path): every directory over each file, and the first name on the way down to it."""
    parts = F.split("path", "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(
        F.when(k == 0, ".").otherwise(F.array_join(F.slice(parts, 1, k), "/")).alias("above"), F.element_at(parts, k + 1).alias("below"), (F.size(parts) - 1 - k).alias("depth")))
    return others.select("path", "name", F.explode(ways).alias("w")).select("path", "name", "w.above", "w.below", "w.depth")


def infrastructure(modules: DataFrame, others: DataFrame, found: DataFrame) -> DataFrame:
    """Containers, orchestration and GraphQL schemas of modules(dir), in the columns of detected().

    A schema file up to three directories down counts where `found` knows no GraphQL framework of the module.
    """
    above = _above(others).join(modules.select("dir"), F.col("above") == F.col("dir"))
    rows = []
    for i, (name, category, key, files, dirs) in enumerate(INFRA):
        here = ((F.col("depth") == 0) & F.col("name").isin(files)) | ((F.col("depth") > 0) & F.col("below").isin(dirs))
        hit = above.where(here).groupBy("dir").agg(F.min("below").alias("source"))
        rows.append(hit.select("dir", F.struct(F.lit(4).alias("stage"), F.lit(i).alias("ord")).alias("rank"), F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(None).cast("string").alias("version"), "source", F.lit(key).alias("doc_key")))
    schemas = above.where(F.col("name").rlike("\\.(graphql|gql)$") & (F.col("depth") <= 3)).groupBy("dir").agg(F.min("path").alias("source"))
    schemas = schemas.join(found.where(F.col("doc_key").isin("graphql", "graphql-java", "@apollo/client")).select("dir"), "dir", "left_anti")
    rows.append(schemas.select("dir", F.struct(F.lit(5).alias("stage"), F.lit(0).alias("ord")).alias("rank"), F.lit("graphql").alias("name"), F.lit("api").alias("category"), F.lit(None).cast("string").alias("version"), "source", F.lit("graphql").alias("doc_key")))
    return reduce(DataFrame.union, rows)


def analyze(spark: SparkSession, root: str, config: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(module, path, type, rank, name, category, version, source, doc_key): the frameworks of each module, each key once.

    Without config, root counts if it has any framework, and so does every directory with
    a build file at most MAX_DEPTH down. With config {module: (path, type)} only the paths
    listed, as far as they exist, and the types they were given.
    """
    others = materialize(listing(spark, root), "listing")
    files = build_files(spark, root, wrappers=True)
    found = materialize(detected(files, others), "detected")
    if config is None:
        marked = others.where(F.col("name").isin(list(MARKERS)) & (F.size(F.split("path", "/")) <= MAX_DEPTH + 1)).select("dir")
        modules = marked.union(spark.createDataFrame([(".",)], "dir string")).distinct()
        modules = modules.select(F.when(F.col("dir") == ".", "root").otherwise(F.element_at(F.split("dir", "/"), -1)).alias("module"), "dir", F.lit(None).cast("string").alias("given"))
    else:
        rows = [(name, path.strip("/").removeprefix("./") or ".", kind) for name, (path, kind) in config.items()]
        modules = spark.createDataFrame(rows, "module string, dir string, given string")
        there = _above(others).select(F.col("above").alias("dir")).distinct()
        modules = modules.join(there, "dir", "left_semi")
    every = found.join(modules.select("dir").distinct(), "dir", "left_semi")
    every = every.union(infrastructure(modules.select("dir").distinct(), others, every))
    once = prefer_versioned(every, ["dir", "doc_key"], "version", "rank")
    kinds = once.groupBy("dir").agg(module_type(F.collect_set("category")).alias("inferred"))
    out = modules.join(once, "dir").join(kinds, "dir")
    return out.select("module", F.col("dir").alias("path"), F.coalesce("given", "inferred").alias("type"), "rank", "name", "category", "version", "source", "doc_key")


def stack_by_category(found: DataFrame) -> DataFrame:
    """(category, name, version, doc_key): every framework of a category once, as first seen over the modules in path order."""
    return keep_one(found, ["category", "doc_key"], [F.col("path"), F.col("rank")]).select("category", "name", "version", "doc_key")


def distinct_frameworks(found: DataFrame) -> DataFrame:
    """(doc_key, version, total): each key with the version first seen, and how many keys there are."""
    first = found.groupBy("doc_key").agg(F.min_by("version", F.struct("path", "rank")).alias("version"))
    return first.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))  # a few dozen keys


def detected_version(key: str) -> Column:
    """The first known version of a framework, by key or by name, as an aggregate over analyze()'s rows."""
    mine = ((F.col("doc_key") == key) | (F.col("name") == key)) & F.col("version").isNotNull() & (F.col("version") != "")
    return F.min_by(F.when(mine, F.col("version")), F.when(mine, F.struct("path", "rank")))


def used_in(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, modules): the modules in which each of keys(key) was found, by key or by name."""
    named = found.select(F.explode(F.array_distinct(F.array("doc_key", "name"))).alias("key"), "module")
    return named.join(keys, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def version_ranges(spark: SparkSession) -> DataFrame:
    """RANGES as rows for stack.match_versions."""
    return spark.createDataFrame([(k, i, lo, hi) for k, each in RANGES.items() for i, (lo, hi) in enumerate(each)], "key string, ord int, min_major int, max_major int")


def supported_frameworks(spark: SparkSession, custom: dict[str, list[tuple[int | None, int | None]]]) -> DataFrame:
    """(group, key, ranges) of the built-in keys and the custom ones, each once; ranges are shown where there are several."""
    group_of = {k: g for g, keys in GROUPS.items() for k in keys}
    # A custom key replaces the built-in ranges of its name.
    rows = []
    for key in dict.fromkeys([*group_of, *RANGES, *custom]):
        ranges = sorted(custom.get(key) or RANGES.get(key) or [(None, None)], key=lambda r: r[0] or 0)
        shown = ", ".join(f"{'?' if lo is None else lo}-{'latest' if hi is None else hi - 1}" for lo, hi in ranges) if len(ranges) > 1 else None
        rows.append((group_of.get(key, OTHER), key, shown))
    return spark.createDataFrame(rows, "group string, key string, ranges string")


def module_type(categories: Column) -> Column:
    """Frontend ahead of infrastructure ahead of backend."""
    has = lambda *c: reduce(lambda a, b: a | b, [F.array_contains(categories, x) for x in c])
    return F.when(has("frontend"), "frontend").when(has("orchestration", "container"), "infra").when(has("backend"), "backend").otherwise("unknown")
