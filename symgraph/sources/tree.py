"""A source tree as a Spark data source: directories are partitions, and what is not wanted is never opened.

`spark.read.format("source_tree").load(root)` gives one row for each file below root, or with an
error for each file or directory that could not be read. Directories are planned breadth
first until there are enough of them for the executors; each task then walks its own. Links are not followed.
Root is a local path or any URI that pyarrow's file systems know; executors have to see it.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from symgraph.session import ship

SCHEMA = "path string, ending string, length bigint, content binary, error string"
ARROW = pa.schema([("path", pa.string()), ("ending", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Directories that are planned at most before tasks walk on, and what a batch of rows holds.
PLANNED, BATCH_ROWS, BATCH_BYTES = 256, 256, 8_000_000


@dataclass
class Directory(InputPartition):
    """A directory below root, "" for root itself, and whether those below it belong to the task as well."""

    path: str
    depth: int
    whole: bool

    def __init__(self, path: str, depth: int, whole: bool):
        super().__init__(path)
        self.path, self.depth, self.whole = path, depth, whole


def _joined(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


class _Local:
    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        """(name, is directory, size), links left out."""
        out = []
        with os.scandir(os.path.join(self.root, folder)) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    out.append((e.name, True, 0))
                elif e.is_file(follow_symlinks=False):
                    out.append((e.name, False, e.stat(follow_symlinks=False).st_size))
        return sorted(out)

    def content(self, path: str) -> bytes:
        with open(os.open(os.path.join(self.root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
            if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
                raise OSError("not a regular file")
            return f.read()


class _Remote:
    def __init__(self, root: str):
        from pyarrow import fs

        self.kinds = fs
        self.store, self.root = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> list[tuple[str, bool, int]]:
        found = self.store.get_file_info(self.kinds.FileSelector(f"{self.root}/{folder}".rstrip("/")))
        return sorted((i.base_name, i.type == self.kinds.FileType.Directory, i.size or 0) for i in found)

    def content(self, path: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()


def _opened(root: str):
    local = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    return _Remote(root) if "://" in local else _Local(local.rstrip("/") or "/")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        asked = lambda name: json.loads(options[name]) if options.get(name) else None
        self.skip, self.endings, self.names = set(asked("skip") or []), asked("endings"), asked("names")
        self.depth, self.most = asked("depth"), asked("most")
        self.content = options.get("content", "true").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on ending and upper bounds on length keep files closed; Spark checks all filters again."""
        for f in filters:
            match f:
                case EqualTo(("ending",), value):
                    self.endings = [e for e in ([value] if self.endings is None else self.endings) if e == value]
                case In(("ending",), values):
                    self.endings = [e for e in (values if self.endings is None else self.endings) if e in values]
                case LessThanOrEqual(("length",), value) | LessThan(("length",), value):
                    self.most = value if self.most is None else min(self.most, value)
            yield f

    def _down(self, name: str, depth: int) -> bool:
        return not name.startswith(".") and name not in self.skip and (self.depth is None or depth <= self.depth)

    def partitions(self) -> list[Directory]:
        store, flat, level, depth = _opened(self.root), [], [""], 0
        while level and len(flat) + len(level) < PLANNED:
            below = []
            for folder in level:
                flat.append(Directory(folder, depth, False))
                try:
                    below += [_joined(folder, n) for n, is_dir, _ in store.entries(folder) if is_dir and self._down(n, depth + 1)]
                except OSError:
                    continue  # its own task reports it
            level, depth = below, depth + 1
        return flat + [Directory(folder, depth, True) for folder in level]

    def _wanted(self, name: str, ending: str, length: int) -> bool:
        return (self.endings is None or ending in self.endings) and (self.names is None or name in self.names) and (self.most is None or length <= self.most)

    def _rows(self, part: Directory) -> Iterator[tuple]:
        store, open_ = _opened(self.root), [(part.path, part.depth)]
        while open_:
            folder, depth = open_.pop()
            try:
                entries = store.entries(folder)
            except OSError as e:
                yield folder or ".", None, None, None, f"{type(e).__name__}: {e.strerror or e}"
                continue
            for name, is_dir, length in entries:
                path, ending = _joined(folder, name), os.path.splitext(name)[1][1:].lower()
                if is_dir:
                    if part.whole and self._down(name, depth + 1):
                        open_.append((path, depth + 1))
                elif self._wanted(name, ending, length):
                    try:
                        yield path, ending, length, store.content(path) if self.content else None, None
                    except OSError as e:
                        yield path, ending, length, None, f"{type(e).__name__}: {e.strerror or e}"

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            # A name that is not UTF-8 is shown with replacement characters.
            row = (row[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), *row[1:])
            rows.append(row)
            held += len(row[3] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), ARROW)], schema=ARROW)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(
    spark: SparkSession, root: str, skip: list[str] = (), depth: int | None = None, endings: list[str] | None = None, names: list[str] | None = None, most: int | None = None, content: bool = True
) -> DataFrame:
    """(path, ending, length, content, error) of the files below root, paths relative to it.

    Directories that are hidden, named in skip or more than depth below root are never listed. Files of other
    endings or names, or of more than `most` bytes, are never opened, and none is where
    content is off. A file or directory that cannot be read is a row with its error; a root that is missing too.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    options = {"skip": json.dumps(sorted(skip)), "content": str(content).lower()}
    options |= {k: json.dumps(v) for k, v in (("depth", depth), ("endings", endings), ("names", names), ("most", most)) if v is not None}
    return spark.read.format("source_tree").options(**options).load(root)
