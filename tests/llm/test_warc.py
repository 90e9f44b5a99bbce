import base64
import glob
import gzip
import hashlib

from symgraph.llm import warc

SCHEMA = "page_id long, url string, html string, key string, id int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_url_keys():
    assert warc.url_key("https://A.example.com:443/x/y?q=1") == "com,example,a)/x/y?q=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url" and warc.url_key("http://[bad") == "http://[bad"


def _expected(rows, least=0):
    by = {}
    for i, _, html in rows:
        by.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        known = [x for x in by[data] if x is not None]
        top = max(known) if known and len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.example.com/1", "same"), (2, "http://b.example.com/1", "same"), (3, "http://a.example.com/1", None), (4, None, ""),
    (5, "http://a.example.com/é", "é🙂" * 50000), (6, "http://[bad", "x\r\n\r\ny"), (None, "http://n.example.com", "other"), (7, "line\nbreak", "seven"),
] + [(100 + i, "http://hot.example.com/same", f"page {i % 7}") for i in range(60)]


def test_round_trip(spark):
    pages = _pages(spark, ROWS)
    for least in (0, 5):
        captures = warc.write_archives(pages, least_payload=least, archive_bytes=2000)
        index = warc.build_index(captures, shards=4, block_lines=8)
        got = warc.read_captures(pages, index, with_payload=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == _expected(ROWS, least)
        text = {i: (h or "").encode() for i, _, h in ROWS}
        assert all(r.payload == text[r.page_id] for r in got if r.record_type == "response")
    one = _pages(spark, [ROWS[0], (999, "http://absent.example.com/", "")])
    assert [r.page_id for r in warc.read_captures(one, index).collect()] == [1]
    folder = captures.first().archive.rsplit("/", 1)[0].removeprefix("file:")
    assert all(gzip.open(f).read().count(b"WARC/1.1\r\n") >= 1 for f in glob.glob(f"{folder}/*.warc.gz"))


def test_repeated_rows_and_empty_tables(spark):
    pages = _pages(spark, [(1, "u", "a"), (1, "u", "a")])
    got = warc.read_captures(pages, warc.build_index(warc.write_archives(pages))).collect()
    assert [r.record_type for r in got] == ["response", "response"]
    none = _pages(spark, [])
    assert warc.read_captures(none, warc.build_index(warc.write_archives(none))).count() == 0
