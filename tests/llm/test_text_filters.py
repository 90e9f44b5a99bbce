import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symgraph.llm import decontaminate as D
from symgraph.llm import toxicity as X
from symgraph.llm.queries import op3_decontaminate, op6_toxicity

SCHEMA = "doc_id long, text string, leaks string, id int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def _least_edits(item: str, text: str) -> int:
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("letters", ["thenorais", "абвгдежзий", "日本語の文章から"])
def test_leaks_equal_brute_force_on_edited_passages(letters):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 4, 8, 20, 40]))) for _ in range(24)]
    block = D.Block(list(range(24)), items, 0.1)
    assert [int(k) for k in block.edits] == [len(t) // 10 for t in items] and (block.need >= 1).all()
    texts = []
    for trial in range(60):
        i = rng.randrange(24)
        s = list(items[i])
        for _ in range(rng.randint(0, int(block.edits[i]) + 2)):
            at, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.4:
                s[at] = rng.choice("xyzабв")
            elif kind < 0.7 and len(s) > 1:
                del s[at]
            else:
                s.insert(at, rng.choice("xyzабв"))
        texts.append(D.normalize(" ".join([word() for _ in range(20)] + ["".join(s)] + [word() for _ in range(20)])))
    for text, got in zip(texts, block.search(texts)):
        for j in range(24):
            edits = _least_edits(items[j], text)
            assert got.get(j) == (edits if edits <= block.edits[j] else None)


def test_leaks_on_odd_tables(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again and again."), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    text = "x " * 50000 + "the QUICK brown\n fox jumps over the lazy cog again and again." + " y" * 50000
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "nothing here"), (5, "a tiny one")]
    for size in (1, 10, 2_000_000):
        got = D.find_leaks(_docs(spark, rows), bench, block_chars=size).select("doc_id", F.col("leaks.item").alias("items")).collect()
        assert sorted((r.doc_id, tuple(r["items"])) for r in got) == [(1, ()), (2, ()), (3, (1,)), (3, (1,)), (4, ()), (5, (4,))]
    assert D.find_leaks(_docs(spark, []), bench).count() == 0
    assert D.find_leaks(_docs(spark, rows), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_equal_brute_force_on_the_smallest_tables(spark, sf):
    bench = [(b.item_id, D.normalize(b.text)) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(d.doc_id, D.normalize(d.text)) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in op3_decontaminate(spark, sf).collect()}
    verbatim = {(d, b) for d, text in docs for b, item in bench if item and item in text}
    assert verbatim == {k for k, edits in got.items() if edits == 0}
    texts = dict(docs)
    items = dict(bench)
    assert all(_least_edits(items[b], texts[d]) == edits <= len(items[b]) // 10 for (d, b), edits in got.items() if len(texts[d]) < 3000)


def test_kernel_tolerates_gaps_and_insertions():
    kernel = X.Kernel(["idiot", "clown"])
    value = kernel.of(["idiot", "idxiot", "i-d-i-o-t", "idiots", "table", "clxown"])
    assert value[0, 0] == pytest.approx(1 - X.FLOOR, abs=1e-4)
    assert value[1, 0] > 0 and value[3, 0] > 0 and value[5, 1] > 0
    assert value[4].sum() == 0 and value[1, 1] == 0
    assert X.letters_only("I.d.i.o.t, two$$ 3x") == ["idiot", "two", "x"]


def _subsequences(word):
    """Weights of all gapped three-letter subsequences within the span, by enumeration."""
    from itertools import combinations

    out: dict = {}
    for at in combinations(range(len(word)), 3):
        span = at[2] - at[0] + 1
        if span <= X.SPAN:
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0) + X.DECAY**span
    return out


def test_kernel_equals_enumerated_subsequences():
    rng = random.Random(9)
    landmarks = ["idiot", "moron", "banana", "scumbag", "abcabcabc"]
    words = landmarks + ["".join(rng.choice("abcdimnorstu") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    got = X.Kernel(landmarks).of(words)
    feats = [_subsequences(w) for w in words]
    norm = [sum(v * v for v in f.values()) ** 0.5 for f in feats]
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            value = sum(feats[i].get(k, 0) * v for k, v in feats[j].items()) / (norm[i] * norm[j])
            spans = [b - a for a in range(len(w)) for b in range(a + 1, len(w) + 1) if _holds(w[a:b], m)]
            held = (len(m) / min(spans)) ** X.HELD * (1 - X.FLOOR) if spans else 0
            assert got[i, j] == pytest.approx(max(value - X.FLOOR, held, 0), abs=1e-5), (w, m)


def _holds(word, landmark):
    letters = iter(word)
    return all(c in letters for c in landmark)


def test_mapped_documents_have_a_positive_semidefinite_gram_matrix():
    kernel = X.Kernel(["idiot", "moron", "scumbag", "trash"])
    gram = kernel.of(kernel.landmarks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-2 * np.eye(4))
    mapped = X._mapped(kernel.pool(["an idxiot", "morons all", "", "trash i d i o t", "calm words"]).astype(float), vectors / np.sqrt(np.maximum(values, 1e-2)))
    assert np.linalg.eigvalsh(mapped @ mapped.T).min() > -1e-9


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(1,), (None,)], "doc_id long").select(X.in_training_fold(F.col("doc_id")).alias("t")).collect()
    assert all(r.t is not None for r in rows)


def test_held_out_toxicity(spark):
    rows = op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits / sum(r.predicted for r in rows) > 0.95 and hits / sum(r.toxic for r in rows) > 0.85


def test_toxicity_on_odd_tables(spark):
    labelled = spark.createDataFrame([(i, ("you idiot", "such a clown")[i % 8 // 4] if i % 4 == 0 else f"calm words {i}", int(i % 4 == 0)) for i in range(200)] + [(900, None, 1), (901, "", 0), (902, "x", None)], "id long, text string, label int")
    model = X.train(labelled)
    rows = [(1, None), (2, ""), (3, "what an idiot"), (3, "what an idiot"), (4, "calm " * 40000), (5, "calm words")]
    got = X.score(_docs(spark, rows), model).collect()
    assert len(got) == 6 and all(0 <= r.toxicity <= 1 for r in got)
    score = {r.doc_id: r.toxicity for r in got}
    assert score[3] > 0.7 and max(score[i] for i in (1, 2, 4, 5)) < 0.5
    assert X.score(_docs(spark, []), model).count() == 0
    blank = X.train(labelled.limit(0))
    assert X.score(_docs(spark, rows), blank).where("toxicity >= 0.7").count() == 0


def test_pipeline_keeps_what_each_stage_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept, had = {r.doc_id: r for r in out.collect()}, {r.doc_id: r for r in docs.collect()}
        assert kept and kept.keys() <= had.keys()
        if name == "secrets":
            assert kept.keys() == had.keys() and all(r.n_chars == len(r.text) for r in kept.values() if r.text != had[r.doc_id].text)
        else:
            assert all(kept[i] == had[i] for i in kept)
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == set(kept) and all(len(r.token_ids) == 4 * r.n_tokens for r in final)


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
