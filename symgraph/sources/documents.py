"""Framework documents: landed pages, the registry of frameworks, and which text a framework's documents come from.

Pages are fetched elsewhere and land as rows (url, text). A request goes to the memory and
disk caches (tables with ages), then to the sources of the framework's version range in
their order; what is found is cached whole and by section.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import cache_key, host_allowed
from symgraph.operators import dml, html, sections
from symgraph.sources import cache

# Branches and file names a README is looked for under, in order; lengths that count as useful; how long memory and how many entries it keeps.
BRANCHES = ["main", "master"]
READMES = ["README.md", "readme.md", "Readme.md", "README.adoc", "readme.adoc", "README.rst", "readme.rst", "README.markdown", "readme.markdown", "README.txt", "README"]
LEAST_README, MOST_README = 100, 30_000
POINTER_CHARS, POINTER_LINES = 300, 5
MEMORY_SECONDS, MEMORY_ENTRIES = 1800, 200


def landed_texts(pages: DataFrame) -> DataFrame:
    """(url, text) of landed pages whose host is allowed; a page that failed has an empty text."""
    return pages.where(host_allowed(F.col("url"))).select("url", F.coalesce("text", F.lit("")).alias("text"))


def readme_candidates(repos: DataFrame) -> DataFrame:
    """(repo, rank, branch, url): every branch with every file name, in the order tried."""
    tries = [(i * len(READMES) + k, b, f) for i, b in enumerate(BRANCHES) for k, f in enumerate(READMES)]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(b).alias("branch"), F.lit(f).alias("file")) for r, b, f in tries]))
    return repos.select("repo", each.alias("t")).select("repo", "t.rank", "t.branch", F.concat(F.lit("https://raw.githubusercontent.com/"), "repo", F.lit("/"), "t.branch", F.lit("/"), "t.file").alias("url"))


def readmes(repos: DataFrame, landed: DataFrame) -> DataFrame:
    """(repo, text): the first README of repos(repo) that is useful, cut at MOST_README characters.

    A short README that is only a path to another one stands for that one, if it landed and is useful.
    """
    tries = readme_candidates(repos).join(landed, "url").where(F.length("text") > 0)
    trimmed = F.trim("text")
    lines = F.filter(F.transform(F.split(trimmed, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    path = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "^\\W*([\\w./-]+\\.(?:md|adoc|rst|txt|markdown))\\W*$", 1)), lambda x: x != ""), F.lit(0))
    pointer = F.when((F.length(trimmed) <= POINTER_CHARS) & (F.size(lines) <= POINTER_LINES), F.concat(F.lit("https://raw.githubusercontent.com/"), "repo", F.lit("/"), "branch", F.lit("/"), F.regexp_replace(path, "^\\.?/", "")))
    target = landed.select(F.col("url").alias("pointer"), F.col("text").alias("followed"))
    found = tries.withColumn("pointer", pointer).join(target, "pointer", "left")
    useful = F.when(F.length("followed") > LEAST_README, F.col("followed")).when(F.length("text") > LEAST_README, F.col("text"))
    best = dml.keep_one(found.withColumn("useful", useful).where("useful is not null"), ["repo"], [F.col("rank")])
    return best.select("repo", F.substring("useful", 1, MOST_README).alias("text"))


def converted(text: Column, markdown: Column) -> Column:
    """What a supplied page gives: its Markdown where it is HTML and that is long enough, else the text."""
    return F.when(text.contains("<") & (F.length(markdown) > cache.LEAST_SUPPLIED), markdown).otherwise(text)


def supplied_texts(landed: DataFrame) -> DataFrame:
    """(url, text) of landed pages as they count when their URL was supplied."""
    md = html.html_to_markdown(landed, "text", "markdown") if "markdown" not in landed.columns else landed
    return md.select("url", converted(F.col("text"), F.col("markdown")).alias("text"))


@dataclass(frozen=True)
class Entry:
    """Where the documents of a range of major versions are: the lower bound in it, the upper one not."""

    description: str
    github: str | None = None
    llms_txt: str | None = None
    min_major: int | None = None
    max_major: int | None = None


@dataclass
class Documents:
    """The registry and the caches of one workspace.

    landed(url, text) are fetched pages; disk(framework, version, section, content,
    fetched_at) is the written cache, memory of the same columns the one that lives MEMORY_SECONDS.
    """

    spark: SparkSession
    landed: DataFrame
    disk: DataFrame | None = None
    builtin: dict[str, list[Entry]] = field(default_factory=dict)
    custom: dict[str, list[Entry]] = field(default_factory=dict)
    urls: dict[tuple[str, str], str] = field(default_factory=dict)
    memory: DataFrame | None = None

    SCHEMA = "framework string, version string, section string, content string, fetched_at long"

    def __post_init__(self):
        self.landed = landed_texts(self.landed)
        self.disk = self.disk if self.disk is not None else self.spark.createDataFrame([], self.SCHEMA)
        self.memory = self.spark.createDataFrame([], self.SCHEMA)

    # registry

    def add_framework(self, key: str, entry: Entry) -> int:
        """Register one more version range; ranges stay sorted by their lower bound. What was remembered of the key goes."""
        self.custom[key] = sorted([*self.custom.get(key, []), entry], key=lambda e: e.min_major or 0)
        self._forget(key)
        return len(self.custom[key])

    def remove_framework(self, key: str) -> bool:
        """Unregister a custom framework and drop all versions of it from the caches; built-in ones stay."""
        existed = self.custom.pop(key, None) is not None
        self._forget(key)
        self.disk = cache.invalidate(self.disk, key)
        return existed

    def _forget(self, key: str) -> None:
        self.memory = cache.invalidate(self.memory, key)
        self.urls = {k: u for k, u in self.urls.items() if k[0] != key}

    def available(self) -> list[str]:
        return list(dict.fromkeys([*self.builtin, *self.custom]))

    def entry(self, key: str, version: str | None) -> Entry | None:
        """The range that covers the version's major number, tried from the last back; the last where none does."""
        ranges = self.custom.get(key) or self.builtin.get(key)
        if not ranges:
            return None
        digits = "".join(c if c.isdigit() else " " for c in (version or "")).split()
        major = int(digits[0]) if digits and (version or "").lstrip("^~>=< ")[:1].isdigit() else None
        fits = [e for e in ranges if major is not None and (e.min_major or 0) <= major and (e.max_major is None or major < e.max_major)]
        return (fits or ranges)[-1]

    def describe(self, key: str, version: str | None = None) -> str | None:
        found = self.entry(key, version)
        return found.description if found else None

    # sources

    def resolved_url(self, key: str, version: str | None = None) -> str | None:
        return self.urls.get((key, version or "latest"))

    def _sources(self, key: str, version: str | None) -> DataFrame:
        """(source, text) of what landed for a framework: at most three rows."""
        e = self.entry(key, version)
        parts = []
        if e and e.llms_txt:
            parts.append(self.landed.where(F.col("url") == e.llms_txt).select(F.lit("llms").alias("source"), "text"))
        if e and e.github:
            repo = self.spark.createDataFrame([(e.github,)], "repo string")
            parts.append(readmes(repo, self.landed).select(F.lit("readme"), "text"))
        url = self.resolved_url(key, version)
        if url:
            parts.append(supplied_texts(self.landed.where(F.col("url") == url)).select(F.lit("supplied"), "text"))
        out = self.spark.createDataFrame([], "source string, text string")
        for part in parts:
            out = out.union(part)
        return out

    def _best(self, key: str, version: str | None, order: dict[str, int]) -> str | None:
        rows = self._sources(key, version).select(F.lit(key).alias("framework"), F.lit(version or "latest").alias("version"), "source", F.col("text").alias("content"))
        best = cache.best_source(rows, order).first()
        return best.content if best else None

    def _keep(self, key: str, version: str | None, content: str, now: int) -> None:
        """Cache a text whole and by section; the memory is pruned as it grows."""
        tag = version or "latest"
        whole = self.spark.createDataFrame([(key, tag, "_full", content, now)], self.SCHEMA)
        parts = sections.section_map(sections.split_sections(whole, "framework", "content")).select(F.lit(key).alias("framework"), F.lit(tag).alias("version"), cache_key(F.col("section_id")).alias("section"), "content", F.lit(now).cast("long").alias("fetched_at"))
        self.disk = cache.write_entries(self.disk, whole.union(parts))
        self.memory = dml.pruned_cache(cache.write_entries(self.memory, whole), F.lit(now), MEMORY_SECONDS, MEMORY_ENTRIES, "fetched_at", "framework")

    def supply_url(self, key: str, url: str, version: str | None = None, now: int = 0) -> DataFrame:
        """Remember a URL, drop the framework's cache, and take its documents: that page first, then the other sources, then a notice."""
        self.urls[(key, version or "latest")] = url
        self.disk = cache.invalidate(self.disk, key)
        self.memory = self.memory.where(~((F.col("framework") == key) & (F.col("version") == (version or "latest"))))
        content = self._best(key, version, cache.SUPPLY_ORDER) or f"## {key}\n\nNo documents yet. Supply the URL of this framework's documentation."
        self._keep(key, version, content, now)
        return self.sections(key, version, now)

    def ensure(self, key: str, version: str | None = None, now: int = 0) -> str | None:
        """The whole text of a framework's documents, or None where a URL has to be supplied."""
        tag = version or "latest"
        for table, ttl in ((self.memory, MEMORY_SECONDS), (self.disk, cache.TTL_SECONDS)):
            hit = cache.read_live(table, F.lit(now), ttl).where((F.col("framework") == key) & (F.col("version") == tag) & (F.col("section") == "_full")).first()
            if hit:
                return hit.content
        content = self._best(key, version, cache.ENSURE_ORDER)
        if content is None and self.resolved_url(key, version):
            content = self._best(key, version, cache.SUPPLY_ORDER)
        if content is not None:
            self._keep(key, version, content, now)
        return content

    def sections(self, key: str, version: str | None = None, now: int = 0) -> DataFrame:
        """The nested sections of a framework's documents; none where a URL has to be supplied."""
        content = self.ensure(key, version, now)
        rows = self.spark.createDataFrame([(f"{key}:{version or 'latest'}", content)] if content is not None else [], "doc string, content string")
        return sections.nest_sections(sections.split_sections(rows, "doc", "content"))

    def needs_url(self, key: str, version: str | None = None) -> str:
        """What to ask for where no source is known."""
        named = f"{key} {version}" if version else key
        return f"No documents of {named} are known ({self.describe(key, version) or f'{key} documentation'}). Supply the URL of the main reference or guide page, as HTML or Markdown."
