"""Scalar text functions of the graph as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a task description.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "must",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "that", "these", "those",
    "and", "but", "or", "nor", "not", "so", "yet", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "about", "between", "through", "during", "before", "after",
    "up", "down", "out", "off", "over", "under", "again", "all", "each", "every", "both", "few", "more", "most", "some", "any", "no", "just", "very", "also", "too", "only",
    "fix", "add", "update", "change", "remove", "refactor", "implement", "delete", "modify", "make", "move", "rename", "write", "check", "find", "look", "get", "set", "new",
]
# Hosts that documents may be fetched from, with what lies below them.
ALLOWED_HOSTS = [
    "github.com", "raw.githubusercontent.com", "api.github.com", "objects.githubusercontent.com", "docs.spring.io", "spring.io", "hibernate.org", "react.dev", "nextjs.org", "tailwindcss.com",
    "graphql.org", "docs.docker.com", "kubernetes.io", "www.postgresql.org", "dev.mysql.com", "www.mongodb.com", "docs.mongodb.com", "redis.io", "typescriptlang.org", "www.typescriptlang.org",
    "docs.scala-lang.org", "www.scala-lang.org", "docs.gradle.org", "gradle.org", "maven.apache.org", "sbt-scala.org", "www.scala-sbt.org", "junit.org",
]

#: Letters with marks and the letters they are built on, from Unicode's decompositions.
_MARKED = {chr(c): d[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFD", chr(c))) and d[0] != chr(c) and d[0].isascii()}


def fold(text: Column) -> Column:
    """Lower case without the marks on Latin letters."""
    return F.lower(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; everything else separates."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def extract_terms(text: Column) -> Column:
    """Words longer than one character that are no stop words; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9_\\s-]", " "), "\\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def normalize_path(path: Column) -> Column:
    """No trailing slashes; :name and {name} become {param}."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), ":[A-Za-z0-9_]+", "{param}"), "\\{[^}]+\\}", "{param}")


def slugify(title: Column, most: int = 60) -> Column:
    """Lower case, spaces to dashes, ASCII letters, digits and dashes only, no dash at either end."""
    kept = F.regexp_replace(F.lower(title), "[^a-z0-9\\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, "\\s+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, most)


def sanitize_id(raw: Column, most: int = 80) -> Column:
    """Lower case; everything but ASCII letters, digits and dashes is a dash, one at a time, none at either end."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9-]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, most)


def cache_key(raw: Column) -> Column:
    """A name that is safe as a file's: letters, digits and . _ @ - stay; anything else is an underscore."""
    return F.regexp_replace(raw, "[^a-zA-Z0-9._@-]", "_")


def relative_paths(message: Column, root: str) -> Column:
    """A message with the project's root taken out of its paths."""
    root = root.rstrip("/")
    return F.replace(F.replace(message, F.lit(root + "/"), F.lit("")), F.lit(root), F.lit("."))


def summarize(text: Column, most: int = 200) -> Column:
    """The first paragraph under the heading: code blocks marked, links as their text, cut with dots."""
    body = F.regexp_replace(text, "^#+[^\\n]*\\n", "")
    code = F.regexp_replace(body, "```[\\s\\S]*?```", "[code]")
    linked = F.regexp_replace(code, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")
    first = F.trim(F.element_at(F.split(F.regexp_replace(linked, "^\\n+", ""), "\\n\\n"), 1))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def truncate(text: Column, most: int, notice: str = "\n\n[truncated]") -> Column:
    """Cut at the last line break ahead of the limit and say so."""
    head = F.substring(text, 1, most)
    lines = F.regexp_replace(head, "\\n[^\\n]*\\z", "")
    return F.when(F.length(text) > most, F.concat(F.when(F.instr(head, "\n") > 1, lines).otherwise(head), F.lit(notice))).otherwise(text)


def annotation_name(raw: Column) -> Column:
    return F.regexp_replace(F.substring_index(raw, "(", 1), "^@", "")


def annotation_value(raw: Column) -> Column:
    """The value an annotation is known by: see parse order in the tests."""
    inner = F.regexp_extract(raw, "\\(([\\s\\S]*)\\)", 1)
    array = F.regexp_extract(inner, "^\\s*\\{\\s*\"([^\"]*)\"", 1)
    lone = F.regexp_extract(inner, "^\\s*\"([^\"]*)\"", 1)
    pairs = F.regexp_extract_all(inner, F.lit("([A-Za-z_]+)\\s*=\\s*\\{?\\s*(\"[^\"]*\"|[^,{}\\s]+)"), F.lit(0))
    wanted = F.filter(pairs, lambda p: p.rlike("^(value|path|field|name)\\s*="))
    pick = F.when(F.size(wanted) > 0, F.element_at(wanted, -1)).when(F.size(pairs) > 0, F.element_at(pairs, 1))
    named = F.regexp_replace(F.regexp_replace(pick, "^[A-Za-z_]+\\s*=\\s*\\{?\\s*", ""), "^\"|\"$", "")
    bare = F.trim(F.element_at(F.split(inner, ","), 1))
    return F.when(F.instr(raw, "(") == 0, F.lit(None)).when(F.trim(inner) == "", F.lit(None)).when(array != "", array).when(lone != "", lone).when(F.size(pairs) > 0, named).otherwise(bare)


def host_allowed(url: Column, hosts: list[str] = ALLOWED_HOSTS) -> Column:
    """http or https, and the host is a listed one or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    listed = F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    return F.coalesce(scheme.isin("http", "https") & listed, F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def last_segments(path: Column, n: int) -> Column:
    """The last n parts of a path, or all of it where it has no more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "/")).otherwise(path)


def clean_version(version: Column) -> Column:
    return F.regexp_replace(version, "^[\\^~>=<\\s]+", "")


def parse_major(version: Column) -> Column:
    return F.regexp_extract(clean_version(version), "^(\\d+)", 1).try_cast("int")


def time_ago(seconds: Column) -> Column:
    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    minutes, hours, days = (F.floor(seconds / k).cast("long") for k in (60, 3600, 86400))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" seconds ago"))).when(minutes < 60, unit(minutes, "minute")).when(hours < 24, unit(hours, "hour")).otherwise(unit(days, "day"))


def capitalized(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, F.length(name)))


def json_texts(text: Column) -> Column:
    """An array of strings written as JSON; null where it is not one."""
    return F.from_json(text, "array<string>")


def snippet(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1."""
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
