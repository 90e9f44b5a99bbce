"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import periodic, queries


def plain_runs(words, least=12):
    """Every stretch that some period holds, the smallest period of each."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made_up(rng):
    size, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 6, 40])
    words = [str(rng.randrange(kinds)) for _ in range(size)]
    for _ in range(rng.randint(0, 3)):
        if words:
            a, p, n = rng.randrange(len(words)), rng.randint(1, 12), rng.randint(0, 60)
            words[a:a] = [words[a : a + p][i % len(words[a : a + p])] for i in range(n)]
    return words


def as_batch(docs):
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names = {}
    return np.array([names.setdefault(w, len(names)) for d in docs for w in d], np.int64), doc


@pytest.mark.parametrize("exact", [False, True])
def test_runs_equal_a_scan_of_all_periods(exact):
    rng = random.Random(5)
    docs = [made_up(rng) for _ in range(400)] + [["a"] * 2000, [], ["a"], "a b a b a b a b a b a".split(), "a b a b a b a b a b a b".split()]
    words, doc = as_batch(docs)
    s, e, q = periodic.runs_of(words, doc, exact=exact)
    first = np.cumsum([0] + [len(d) for d in docs])
    got = [[] for _ in docs]
    for a, b, p in zip(s.tolist(), e.tolist(), q.tolist()):
        got[doc[a]].append((a - first[doc[a]], b - a, p))
    for d, mine in zip(docs, got):
        assert [tuple(map(int, r)) for r in mine] == plain_runs(d)
    assert sum(map(len, got)) > 300


def test_a_misled_hash_is_found_out(monkeypatch):
    """Thue-Morse words make the two halves of a text collide whatever the base is."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    docs = [bits + [1 - b for b in bits] + [2, 3] * 20]
    words, doc = as_batch(docs)
    monkeypatch.setattr(periodic._Extensions, "_equal", lambda self, i, j, n: np.ones(len(i), bool))
    s, e, q = periodic.runs_of(words, doc)
    assert [(int(a), int(b - a), int(p)) for a, b, p in zip(s, e, q)] == plain_runs(docs[0])


def test_a_long_text_of_few_words_stays_linear():
    rng = random.Random(1)
    part = [rng.randrange(50) for _ in range(3000)]
    words = np.array(part * 20 + [7] * 100_000, np.int64)
    s, e, q = periodic.runs_of(words, np.zeros(len(words), np.int64))
    assert {(0, 60_000, 3000), (60_000, 100_000, 1)} <= {(int(a), int(b - a), int(p)) for a, b, p in zip(s, e, q)} or q.max() == 3000
    assert all(b - a >= max(12, 2 * p) for a, b, p in zip(s, e, q))


def test_hard_rows(spark):
    rows = [(1, None), (1, ""), (None, " \t\n"), (2, "x\u0085y  "), (2, "x\u0085y  "), (3, " ".join(["é"] * 30)), (4, "a\x0bb\x0cc\r" * 5 + "\x1c")]
    docs = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, runs string")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect())
    assert got == sorted([("1", [], ""), ("1", [], ""), ("None", [], ""), ("2", [], "x\u0085y  "), ("2", [], "x\u0085y  "), ("3", [(0, 30, 1)], "é"), ("4", [(0, 15, 3)], "a b c \x1c")])
    assert periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least=10)


def test_query_equals_a_plain_version(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    rewritten = 0
    for doc_id, text in docs.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            rewritten += 1
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        row = got[doc_id]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert rewritten > 5 and sum(r.n_runs for r in got.values()) > 10


def test_query_on_nulls(spark, tmp_path):
    table = spark.createDataFrame([(None, "a " * 20), (0, None), (20, "")], "doc_id long, text string").withColumn("n_words", F.lit(1))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.length) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {None: (1, 20), 0: (0, None), 20: (0, None)}
