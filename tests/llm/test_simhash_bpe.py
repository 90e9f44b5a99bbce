import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import bpe, simhash
from symgraph.llm.components import connected_components, local_forest

SCHEMA = "doc_id long, text string, fp string, id int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def _brute_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        counts += np.array([h >> i & 1 for i in range(64)])
    return sum(1 << i for i in range(64) if shingles and counts[i] * 2 > len(shingles))


def test_fingerprints_and_components(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None), (2, " \n\t"), (3, "Two words"), (4, base), (5, base.replace("word7 ", "other ")), (6, base + "  "), (7, "ÀÉ b c d e"), (7, base), (8, "x " * 60000), (9, "A b c d")]
    got = simhash.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    brute = [(i, _brute_fp(t)) for i, t in rows]
    assert sorted((r.doc_id, r.fp % (1 << 64)) for r in got) == sorted(brute)
    name = {f: f for _, f in brute}
    for _ in rows:
        for a in name:
            for b in name:
                if bin(a ^ b).count("1") <= 4:
                    name[a] = name[b] = min(name[a], name[b])
    least = {}
    for i, f in brute:
        least[name[f]] = min(i, least.get(name[f], i))
    assert sorted((r.doc_id, r.component) for r in got) == sorted((i, least[name[f]]) for i, f in brute)


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_every_close_pair_agrees_on_some_mask():
    rng = np.random.default_rng(8)
    for n, count in ((10**5, 5), (10**8, 15), (10**11, 35), (10**15, 70)):
        masks = simhash.top_masks(n, 4)
        assert len(masks) == count
        for _ in range(300):
            flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flipped & m == 0 for m in masks)


@pytest.mark.parametrize(("tile", "parts"), [(20, 5), (1000, 5), (20, 6), (1000, 8)])
def test_near_pairs_join_all_close_codes(spark, tile, parts):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    codes = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            codes.add(int(s) ^ sum(1 << int(b) for b in bits))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_pairs(spark.createDataFrame([(c,) for c in signed], "fp long"), 4, tile, parts)
    comps = {r.node: r.component for r in connected_components(links).collect()}
    arr = np.array(signed, np.int64).view(np.uint64)
    x, y = np.nonzero(np.bitwise_count(arr[:, None] ^ arr) <= 4)
    nodes, roots = local_forest(arr.view(np.int64)[x], arr.view(np.int64)[y])
    root = dict(zip(nodes.tolist(), roots.tolist()))
    groups: dict = {}
    for c in signed:
        groups.setdefault(root.get(c, c), set()).add(comps.get(c, c))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_handle_chains_loops_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (None, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeiotnrs THE.,'!0129\n\té日🙂<|>_-"), max_size=60))
def test_encoder_equals_the_library(text):
    codec = bpe.codec(bpe.default_vocabulary())
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == _CACHED.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == text


_CACHED = _library()


def test_encode_and_decode_tables(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>hi<|endoftext|>"), (4, "same"), (4, "same"), (5, "long text, " * 20000), (6, "a" * 5000)]
    out = bpe.decode(bpe.encode(_docs(spark, rows))).select("doc_id", "token_ids", "decoded").collect()
    assert sorted((r.doc_id, r.decoded) for r in out) == sorted((i, t or "") for i, t in rows)
    for r in out:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == _CACHED.encode(r.decoded, add_special_tokens=False).ids
    assert bpe.encode(_docs(spark, [])).count() == 0
