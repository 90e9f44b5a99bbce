import math
import re
from collections import Counter

import pytest

from symgraph.llm import backoff as B

SCHEMA = "doc_id long, text string, id int, n_words string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _counts(rows, order):
    counts, total = Counter(), 0
    for _, t in rows:
        w = _words(t)
        total += len(w)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return counts, total


def _score(text, counts, total, order, alpha=0.4):
    w, score = _words(text), 0.0
    for at in range(len(w)):
        first = n = min(order, at + 1)
        while n > 1 and not counts[tuple(w[at - n + 1 : at + 1])]:
            n -= 1
        gram = tuple(w[at - n + 1 : at + 1])
        score += (first - n) * math.log(alpha)
        if not counts[gram]:
            score -= math.log(total + 1)
        else:
            score += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total))
    return len(w), score


ROWS = [(1, "the cat sat on the mat The cat ran"), (2, "the cat sat on a log"), (3, None), (4, " \n"), (5, "one"), (6, "two words"), (7, "a b " * 30000), (8, "the cat sat on the mat The cat ran"), (9, "x"), (9, "the cat"), (None, "é É the")]


@pytest.mark.parametrize(("order", "chunk"), [(1, 10), (2, 40), (3, 10**6), (4, 60)])
def test_scores_by_all_other_rows_equal_brute_force(spark, order, chunk, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_CHARS", chunk)
    got = B.score_corpus(_docs(spark, ROWS), order=order, parts=5).collect()
    every, total = _counts(ROWS, order)
    want = []
    for i, t in ROWS:
        own, words = _counts([(i, t)], order)
        want.append((i, *_score(t, every - own, total - words, order)))
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    assert len(got) == len(want)
    for (i, n, score), r in zip(sorted(want, key=key), sorted(((r.doc_id, r.n_words, r.log_score, r.mean_log_score) for r in got), key=key)):
        assert r[:2] == (i, n) and r[2] == pytest.approx(score, abs=1e-6)
        assert r[3] == (pytest.approx(score / n) if n else None)


def test_a_text_that_occurs_twice_scores_apart(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(60))) for i in range(40)]
    got = {r.doc_id: r.mean_log_score for r in B.score_corpus(_docs(spark, [*rows, (100, rows[3][1])])).collect()}
    assert got[3] == got[100] > max(v for i, v in got.items() if i not in (3, 100)) + 0.5


def test_other_texts_back_off(spark):
    train = ROWS[:7]
    rows = [(1, "the cat ran on the log"), (2, "zebra cat sat"), (3, ""), (4, None), (5, "mat on the mat")]
    got = {r.doc_id: r for r in B.score_with(_docs(spark, rows), B.count_table(_docs(spark, train), 3), 3).collect()}
    for i, t in rows:
        n, score = _score(t, *_counts(train, 3), 3)
        assert got[i].n_words == n and got[i].log_score == pytest.approx(score, abs=1e-6)


def test_empty_tables(spark):
    assert B.score_corpus(_docs(spark, [])).count() == 0
    assert B.score_with(_docs(spark, []), B.count_table(_docs(spark, ROWS))).count() == 0
    assert B.score_corpus(_docs(spark, [(1, None)])).first().log_score == 0
