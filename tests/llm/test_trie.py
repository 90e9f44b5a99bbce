"""The prefix trie against one built turn by turn, and against SQL."""

import hashlib
import random
import zlib

import duckdb

from symgraph.llm import queries, sql, trie

COLS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members = {}
    ends = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0, 0) if p in kids else (1, 0)
        saved += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows, tmp_path, name):
    path = tmp_path / name
    spark.createDataFrame([(*r, 1, 2) for r in rows], COLS + ", prior int, size int").write.parquet(f"{path}/conversations.parquet")
    found = queries.op13_prefix_trie(spark, str(path)).collect()
    got = [(r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found]
    return sorted(got)


def test_nodes_equal_those_of_a_trie_built_turn_by_turn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "WIDTHS", (2, 3))
    monkeypatch.setattr(trie, "PIECE", 4)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        if c % 7 == 3:
            continue
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "é", None]) if t % 2 else "user", "x" if t < 3 else rng.choice(["a", "bb", ""])))
    rng.shuffle(rows)
    got = run(spark, rows, tmp_path, "made")
    assert got == plain(rows)
    assert max(r[1] for r in got) > 8 and any(r[3] > 5 for r in got)


def test_hard_rows(spark, tmp_path):
    rows = [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, 1, None, None), (3, 1, "user", "b"), (3, 1, "user", "b"), (-2, 0, "user", "neg")]
    rows += [(5, t, "user", "long " * t) for t in range(70)] + [(6, t, "user", "long " * t) for t in range(70)] + [(11, 5, "user", "y")] + [(7, 0, "user", "")]
    assert run(spark, rows, tmp_path, "hard") == plain(rows)
    assert run(spark, [], tmp_path, "none") == []
    assert run(spark, [(None, 1, "user", "lost")], tmp_path, "null") == []


def test_query_equals_sql(spark, sf):
    got = queries.op13_prefix_trie(spark, sf)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS FROM read_parquet('{sf}/conversations.parquet')")
        wanted = db.execute(sql.ORACLES["op13_prefix_trie"])
        names = [c[0] for c in wanted.description]
        wanted = wanted.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, wanted))
