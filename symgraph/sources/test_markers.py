"""Which scanned files are tests: markers from the build files' test dependencies, or a built-in set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_JUPITER = ["@Test", "@ParameterizedTest", "@RepeatedTest", "@TestFactory", "@TestInstance", "@Nested", "@ExtendWith"]
_SUITES = ["AnyFunSuite", "AnyFlatSpec", "AnyWordSpec", "AnyFreeSpec", "AnyFunSpec", "AnyPropSpec", "AnyFeatureSpec", "FunSuite", "FlatSpec", "WordSpec", "FreeSpec", "FunSpec", "PropSpec", "Suite"]
# Fixed values: (artifacts, imports that mark a test, annotations that do, supertypes that do).
ARTIFACTS = [
    (["junit-jupiter", "junit-jupiter-api"], ["org.junit.jupiter"], _JUPITER, []), (["junit-jupiter-engine"], ["org.junit.jupiter"], [], []), (["junit-jupiter-params"], ["org.junit.jupiter.params"], ["@ParameterizedTest"], []),
    (["junit"], ["org.junit"], ["@Test", "@RunWith", "@Before", "@After"], []), (["testng"], ["org.testng"], ["@Test", "@BeforeClass", "@AfterClass"], []),
    (["mockito-core"], ["org.mockito"], ["@Mock", "@InjectMocks", "@Spy", "@Captor"], []), (["mockito-junit-jupiter"], ["org.mockito"], ["@ExtendWith"], []), (["mockito-inline"], ["org.mockito"], [], []),
    (["assertj-core"], ["org.assertj"], [], []), (["hamcrest", "hamcrest-core", "hamcrest-all"], ["org.hamcrest"], [], []),
    (["spring-boot-starter-test"], ["org.springframework.boot.test", "org.springframework.test"], ["@SpringBootTest", "@DataJpaTest", "@WebMvcTest", "@WebFluxTest", "@MockBean", "@SpyBean"], []),
    (["spring-boot-test"], ["org.springframework.boot.test"], ["@SpringBootTest"], []), (["spring-test"], ["org.springframework.test"], ["@ContextConfiguration"], []), (["quarkus-junit5"], ["io.quarkus.test"], ["@QuarkusTest"], []),
    (["arquillian-junit"], ["org.jboss.arquillian"], [], []), (["rest-assured"], ["io.restassured"], [], []), (["wiremock"], ["com.github.tomakehurst.wiremock"], [], []),
    (["jest"], ["jest", "@jest"], [], []), (["@jest/globals"], ["@jest/globals", "jest"], [], []), (["vitest"], ["vitest"], [], []), (["mocha"], ["mocha"], [], []), (["chai"], ["chai"], [], []), (["sinon"], ["sinon"], [], []),
    (["jasmine", "jasmine-core"], ["jasmine"], [], []), (["@testing-library/react", "@testing-library/jest-dom", "@testing-library/dom", "@testing-library/vue", "@testing-library/angular"], ["@testing-library"], [], []),
    (["supertest"], ["supertest"], [], []), (["nock"], ["nock"], [], []), (["msw"], ["msw"], [], []), (["enzyme"], ["enzyme"], [], []), (["react-test-renderer"], ["react-test-renderer"], [], []),
    (["@playwright/test", "playwright"], ["@playwright"], [], []), (["cypress"], ["cypress"], [], []), (["ava"], ["ava"], [], []), (["tap"], ["tap"], [], []), (["uvu"], ["uvu"], [], []),
    (["scalatest"], ["org.scalatest"], [], _SUITES), (["specs2-core", "specs2"], ["org.specs2"], [], ["Specification", "MutableSpecification"]), (["munit"], ["munit"], [], ["FunSuite"]), (["zio-test"], ["zio.test"], [], []),
    (["weaver-cats"], ["weaver"], [], []), (["utest"], ["utest"], [], []), (["scalacheck"], ["org.scalacheck"], [], []), (["scalamock"], ["org.scalamock"], [], []),
]
# Markers where no build file names a known test dependency.
FALLBACK = (
    [
        "org.junit", "org.testng", "org.mockito", "org.assertj", "org.hamcrest", "org.springframework.boot.test", "org.springframework.test", "io.quarkus.test", "org.jboss.arquillian", "jest", "vitest", "mocha", "chai", "sinon",
        "jasmine", "@testing-library", "@jest", "supertest", "nock", "msw", "enzyme", "react-test-renderer", "@playwright", "cypress", "org.scalatest", "org.specs2", "munit", "zio.test", "weaver", "utest",
    ],
    ["@Test", "@ParameterizedTest", "@RepeatedTest", "@TestFactory", "@SpringBootTest", "@DataJpaTest", "@WebMvcTest", "@WebFluxTest", "@ExtendWith", "@RunWith", "@TestInstance", "@Nested", "@MockBean", "@SpyBean", "@Mock", "@InjectMocks"],
    [*_SUITES, "Specification", "MutableSpecification"],
)


def known_artifacts(spark: SparkSession) -> DataFrame:
    """(artifact, imports, annotations, supertypes) of ARTIFACTS, one row for each artifact."""
    rows = [(a, i, m, t) for names, i, m, t in ARTIFACTS for a in names]
    return spark.createDataFrame(rows, "artifact string, imports array<string>, annotations array<string>, supertypes array<string>")


def detect_markers(deps: DataFrame) -> DataFrame:
    """One row (frameworks, imports, annotations, supertypes) from deps(artifact, scope) of scope test; the built-in set where none is known."""
    spark = deps.sparkSession
    wanted = deps.where("scope = 'test'").select(F.explode(F.array_distinct(F.array(F.lower("artifact"), F.element_at(F.split(F.lower("artifact"), ":"), -1)))).alias("artifact")).distinct()
    hit = F.broadcast(known_artifacts(spark)).join(wanted, "artifact")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = hit.agg(F.array_sort(F.collect_set("artifact")).alias("frameworks"), union("imports"), union("annotations"), union("supertypes"))
    built_in = spark.createDataFrame([FALLBACK], "bi array<string>, ba array<string>, bs array<string>")
    either = lambda c, b: F.when(F.size("frameworks") > 0, F.col(c)).otherwise(F.col(b)).alias(c)
    return found.crossJoin(built_in).select("frameworks", either("imports", "bi"), either("annotations", "ba"), either("supertypes", "bs"))  # one row each


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def test_files(symbols: DataFrame, imports: DataFrame, markers: DataFrame) -> DataFrame:
    """(module, file_path) of the files that the one row of markers calls tests.

    An import that holds a marker anywhere, an annotation that begins with one, or a
    signature that holds a supertype, of any symbol of the file, is enough.
    """
    m = F.broadcast(markers)
    by_import = imports.join(m).where(_any(F.col("imports"), lambda x: F.contains(F.col("import_path"), x))).select("module", "file_path")
    named = symbols.select("module", "file_path", "signature", F.col("annotations").alias("marks")).join(m)
    annotated = _any(F.col("marks"), lambda a: F.exists("annotations", lambda x: F.startswith(a, x)))
    typed = F.coalesce(F.exists("supertypes", lambda x: F.contains(F.col("signature"), x)), F.lit(False))
    return reduce(DataFrame.union, [by_import, named.where(annotated | typed).select("module", "file_path")]).distinct()


test_files.__test__ = False  # a function of the library, not a test
