"""Pages as Markdown, by a tag-by-tag rewrite in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements whose content is dropped.
DROPPED = frozenset("nav header footer script style noscript aside svg".split())


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped = self.pre = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif self.dropped:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "li":
            self.out.append("\n*   ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "blockquote"):
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            return
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "blockquote") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def _escaped(ref: re.Match) -> str:
    """What stands for a reference if only those with a known name or a number, and their semicolon, are to be read."""
    known = ref[1] and (ref[1].startswith("#") or ref[1] in html5)
    return ref[0] if known else "&amp;" + (ref[1] or "")


def to_markdown(html: str | None, open_references: bool = True) -> str:
    """The whole body as Markdown with ATX headings and fenced code; empty where it cannot be read.

    As browsers do, names like &amp are read without their semicolon too; without open_references they stay as they stand.
    """
    body = re.search(r"<body[^>]*>([\s\S]*?)(?:</body>|\Z)", html or "", re.I)
    text = body[1] if body else html or ""
    if not open_references:
        text = re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)?", _escaped, text)
    writer = _Writer()
    try:
        writer.feed(text)
        writer.close()
    except (AssertionError, ValueError):
        return ""
    return re.sub(r"\n{4,}", "\n\n\n", "".join(writer.out)).strip()


def html_to_markdown(pages: DataFrame, html_col: str = "html", out_col: str = "markdown", open_references: bool = True) -> DataFrame:
    """Add each page's Markdown; a null or empty page gives an empty text, a column named like the output is replaced. open_references: see to_markdown()."""
    kept = [f for f in pages.schema.fields if f.name != out_col or f.name == html_col]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType())])

    def convert(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = lambda n: batch.column(batch.schema.get_field_index(n))
            made = pa.array([to_markdown(h.as_py(), open_references) for h in at(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[at(f.name) for f in kept], made], schema.names)

    return pages.mapInArrow(convert, schema)
