"""WARC archives in the shared folder, and a two-level capture index over them.

Records are gzip members, so each can be read on its own. The index sorts captures by
URL key (host labels reversed) into compressed blocks; a sparse directory holds the first
key of each block. A lookup searches the directory, then the block, then reads the
record's byte range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.storage import fresh_path, materialize

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 500
#: Captures in a shard of the index, about.
SHARD_ROWS = 20_000
#: Most shards: the directory of their first keys is what a lookup holds in memory.
MOST_SHARDS = 20_000
#: Bytes of records that one task reads back, about.
READ_BYTES = 8 << 20
CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: com,example,www)/a?b. Unreadable URLs stay as they are."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    except ValueError:
        return text
    if not host:
        return text
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to, date: str) -> bytes:
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = CRLF.join(http) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=False)[1:-1]}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {json.dumps(page_id)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page: {json.dumps(refers_to)}",
        ]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(member: bytes) -> dict:
    """Headers and payload of one compressed record; the payload of a response is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    sizes = dict(line.split(b": ", 1) for line in http.split(CRLF)[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": json.loads(fields["X-Page-ID"]),
        "payload": None if revisit else payload,
        "payload_bytes": int(sizes[b"Content-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": json.loads(fields["X-Refers-To-Page"]) if revisit else None,
    }


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, folder: str | None = None, least_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row under folder (in the shared folder by default); return where each is.

    Among rows with equal payloads of at least `least_payload` bytes the largest id is the
    response and the others revisit it; a row that repeats that id is a response as well,
    and rows with a null id revisit unless no id is known. A null html is an empty payload.
    The result (id, key, archive, offset, length) is a written table: a task that runs
    twice writes a file of another name, and only the one that counted is listed. Other
    columns are ignored; an empty table writes nothing.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    holders = rows.where(F.octet_length("html") >= least_payload).groupBy("digest").agg(F.max("id").alias("holder"))
    typed = rows.join(holders.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left").drop("d")
    id_type = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.StringType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for batch in stream:
            out = []
            for row in batch.to_pylist():
                if sink is None or at >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                revisit = row["holder"] is not None and row["id"] != row["holder"]
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(_record(row["id"], row["url"], row["html"].encode(), digest, revisit, row["holder"], date)) + packer.flush()
                sink.write(member)
                out.append((row["id"], url_key(row["url"]), f"{folder}/{name}", at, len(member)))
                at += len(member)
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("id").type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.string(), pa.int64(), pa.int64())))], schema.names)
        if sink is not None:
            sink.close()

    return materialize(typed.select("id", "url", "html", "digest", "holder").mapInArrow(batches, schema), "warc-captures")


def build_index(captures: DataFrame, shards: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The capture index as a written table: (shard, block, first_key, data).

    Captures are range-partitioned by (key, id), so that a host with most of the pages
    spreads over many shards. data is a compressed run of lines in key order; the other
    columns are the sparse directory. No captures give no blocks.
    """
    shards = shards or min(MOST_SHARDS, max(1, captures.count() // SHARD_ROWS))
    ordered = captures.repartitionByRange(shards, "key", "id").sortWithinPartitions("key", "id")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, lines = TaskContext.get().partitionId(), 0, []

        def packed():
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([lines[0][0]]), pa.array([lines[0][1]], id_type), pa.array([data], pa.binary())], ["shard", "block", "first_key", "first_id", "data"])

        id_type = None
        for batch in stream:
            id_type = batch.schema.field("id").type
            for row in batch.to_pylist():
                lines.append((row["key"], row["id"], row["archive"], row["offset"], row["length"]))
                if len(lines) == block_lines:
                    yield packed()
                    block, lines = block + 1, []
        if lines:
            yield packed()

    id_sql = captures.schema["id"].dataType.simpleString()
    return materialize(ordered.select("key", "id", "archive", "offset", "length").mapInArrow(batches, f"shard int, block int, first_key string, first_id {id_sql}, data binary"), "warc-index")


def _order(key, page_id) -> tuple:
    return (key or "", page_id is not None, page_id if page_id is not None else 0)


def find_captures(queries: DataFrame, index: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(archive, offset, length) of the captures of each different (id, url); what the index does not hold gives no row.

    Queries go to shards by the shards' first keys, at most MOST_SHARDS of them; each shard is then
    searched on its own: its sparse directory by bisection, then the block. A null URL has the empty key.
    """
    id_type = queries.schema[id_col].dataType
    starts = index.where("block = 0").select("shard", "first_key", "first_id").collect()  # MOST_SHARDS rows at most
    starts = sorted((_order(r.first_key, r.first_id), r.shard) for r in starts)
    firsts, homes = [s for s, _ in starts], [h for _, h in starts]
    sent = T.StructType([T.StructField("id", id_type), T.StructField("key", T.StringType()), T.StructField("shard", T.IntegerType())])

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys = [url_key(u) for u in batch.column(1).to_pylist()]
            at = [bisect_right(firsts, _order(k, i)) - 1 for k, i in zip(keys, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array([homes[a] if a >= 0 else -1 for a in at], pa.int32())], sent.names)

    wanted = queries.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).distinct().mapInArrow(assign, sent)

    def look(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = sorted(blocks.to_pylist(), key=lambda r: r["block"])
        directory = [_order(r["first_key"], r["first_id"]) for r in rows]
        opened: tuple[int, list, list] = (-1, [], [])
        places = []
        for want in sorted(_order(k, i) for k, i in zip(asked.column("key").to_pylist(), asked.column("id").to_pylist())):
            at = bisect_right(directory, want) - 1
            while at >= 0:
                if opened[0] != at:
                    lines = [json.loads(x) for x in zlib.decompress(rows[at]["data"]).decode().split("\n")]
                    opened = (at, lines, [_order(x[0], x[1]) for x in lines])
                _, lines, keys = opened
                hi = bisect_right(keys, want)
                lo = hi
                while lo and keys[lo - 1] == want:
                    lo -= 1
                    places.append(tuple(lines[lo][2:]))
                if lo:
                    break
                at -= 1  # equal captures may reach back into the block before
        archive, offset, length = zip(*places) if places else ((), (), ())
        return pa.table({"archive": pa.array(archive, pa.string()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})

    return wanted.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, "archive string, offset long, length long")


def read_captures(queries: DataFrame, index: DataFrame, with_payload: bool = False, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Look up each (id, url) in the index and read its record; captures not in the index give no row.

    The places found are a small written table; ranges of archives of about READ_BYTES are
    then dealt to tasks and each is read in order, a record at a time. A query that repeats
    is answered once for each record of its id and URL. Other columns are ignored; an empty table gives no rows.
    """
    id_type = queries.schema[id_col].dataType
    places = materialize(find_captures(queries, index, id_col, url_col), "capture-places")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    spark = queries.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, total // READ_BYTES)
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES // 8))
    dealt = places.withColumn("stretch", stretch).repartition(int(parts), "archive", "stretch").sortWithinPartitions("archive", "offset")
    fields = [("page_id", id_type.simpleString()), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", id_type.simpleString())]
    fields += [("payload", "binary")] if with_payload else []
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    arrow = {"page_id": id_arrow, "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": id_arrow, "payload": pa.binary()}

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for batch in stream:
            found, held = [], 0
            for row in batch.select(["archive", "offset", "length"]).to_pylist():
                if row["archive"] != opened:
                    store, path = _filesystem(row["archive"])
                    opened, source = row["archive"], store.open_input_file(path)
                source.seek(row["offset"])
                record = parse_record(source.read(row["length"]))
                held += len(record["payload"] or b"") if with_payload else 0
                found.append(record)
                if held > READ_BYTES:
                    yield rows(found)
                    found, held = [], 0
            yield rows(found)

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], arrow[n]) for n, _ in fields], [n for n, _ in fields])

    return dealt.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in fields))
