"""Toxicity by a support vector machine over a gapped subsequence string kernel.

A word's kernel features are its ordered three-letter subsequences, gaps allowed, each
weighted by DECAY to the power of the letters it spans; the kernel of two words is the
cosine of these. Landmark words, chosen from labelled documents, give a Nyström map, so
that an insult with letters put in or left out still falls near its landmark. Where a word
holds all letters of a landmark in order, however many stand between them, the likeness is
at least the landmark's share of the letters spanned, so that letters put in between do not
hide it; runs of single letters are read as one word. For every
landmark a document gives the value of its nearest word, the sum over its words and that
sum's share of the words; a linear machine trained on labelled documents scores these,
and Platt scaling turns its margin into a probability.

Small likeness is taken off (FLOOR) and the order rule is a maximum, so a single value
between two words is no longer a kernel's. The machine does not need it to be: it is
linear in explicit features, so what it uses as kernel, the inner product of two mapped
documents, is positive semidefinite by construction, and the map's whitening clips
whatever eigenvalue of the landmarks' matrix lies below its floor.

LANDMARKS, ALIKE, and the machine's cost were picked by five-fold cross-validation inside
the training fold alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.storage import materialize

DECAY = 0.7
#: A subsequence spans at most so many letters.
SPAN = 6
#: Longer runs of letters are read through overlapping windows.
WINDOW, STRIDE = 9, 4
#: Most landmark words; a landmark is a word or beginning of 4 to WINDOW letters that LEAST_TOXIC toxic documents hold.
LANDMARKS, LEAST_TOXIC = 24, 3
#: Beginnings of words that may be landmarks besides whole words.
STEMS = (5, 6, 7)
#: A landmark occurs in this share of the toxic documents at least, and is less like any other than ALIKE.
LEAST_SHARE, ALIKE = 0.003, 0.85
#: Labelled documents the machine is fitted on, by hash order; a bound, not a share.
FIT_ROWS = 20_000
#: Kernel values below this count as no likeness.
FLOOR = 0.45
#: Words whose (lack of) likeness a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Characters of text taken up at once.
CHUNK_CHARS = 3_000_000
#: Words next to which a landmark's share of a document counts as full.
SHARE = 40

#: Power of the share of letters spanned that counts for a landmark held in order; under 1, as inserted letters say little.
HELD = 0.5

_OFFSETS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]
_JUNK = re.compile(r"[^\w\s]+|[\d_]+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")


def letters_only(text: str | None) -> list[str]:
    """Lower-case words of the whole text without what stands between letters; three or more single letters in a row are one word."""
    return _SPACED.sub(lambda m: "".join(m[0].split()), _JUNK.sub("", (text or "").lower())).split()


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's letters as 6-bit codes in rows of WINDOW, 0 beyond its end, and the row's word."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= WINDOW:
            pieces.append(w)
            owner.append(i)
        else:
            for lo in range(0, len(w) - STRIDE, STRIDE):
                pieces.append(w[lo : lo + WINDOW])
                owner.append(i)
    width = max(map(len, pieces), default=1)
    padded = "".join(p.ljust(width, "\0") for p in pieces)
    points = np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(len(pieces), width)
    latin = (points >= 97) & (points <= 122)
    codes = np.where(points == 0, 0, np.where(latin, points - 96, 27 + points % 37)).astype(np.int32)
    return codes, np.array(owner, np.int64)


def _features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(row, feature, weight) of every gapped subsequence of three letters."""
    n, width = codes.shape
    for a, b in _OFFSETS:
        if b >= width:
            continue
        x, y, z = codes[:, : width - b], codes[:, a : width - b + a], codes[:, b:]
        row, col = np.nonzero(z)
        yield row, (x[row, col] << 12) | (y[row, col] << 6) | z[row, col], DECAY ** (b + 1)


def _letter_bits(words: list[str]) -> np.ndarray:
    """Which letters each word has, as bits; some letters share a bit."""
    bits = np.zeros(len(words), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    np.bitwise_or.at(bits, np.repeat(np.arange(len(words)), lengths), np.uint64(1) << (points % np.uint64(64)))
    return bits


def _norms(codes: np.ndarray) -> np.ndarray:
    """Length of each row's feature vector, equal subsequences added up first."""
    keys, weights = [], []
    for row, feature, weight in _features(codes):
        keys.append((row.astype(np.int64) << 18) | feature)
        weights.append(np.full(len(row), weight))
    if not keys:
        return np.zeros(len(codes))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(weights), len(key))
    return np.sqrt(np.bincount(key >> 18, total**2, len(codes)))


def _least_norms(codes: np.ndarray) -> np.ndarray:
    """A bound from below that needs only the row's letter count: equal subsequences can only add."""
    letters = (codes > 0).sum(axis=1)
    by_count = [np.sqrt(sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS)) for n in range(codes.shape[1] + 1)]
    return np.array(by_count)[letters]


def _span(landmark: str, word: str) -> int:
    """Fewest letters of word that hold landmark's letters in order; 0 where none do."""
    best, lo = 0, 0
    while True:
        end = lo - 1
        for c in landmark:
            end = word.find(c, end + 1)
            if end < 0:
                return best
        start = end + 1
        for c in reversed(landmark):
            start = word.rfind(c, lo, start)
        best = min(best or end + 1 - start, end + 1 - start)
        lo = start + 1


class Kernel:
    """Kernel values of words against the landmarks."""

    def __init__(self, landmarks: list[str]):
        codes, owner = _codes(landmarks)
        keep = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        codes = codes[keep]
        norms = _norms(codes)
        self.size = len(landmarks)
        self.row_of = np.full(1 << 18, -1, np.int32)
        used: dict[int, int] = {}
        cells = []
        for row, feature, weight in _features(codes):
            for r, f in zip(row.tolist(), feature.tolist()):
                cells.append((used.setdefault(f, len(used)), r, weight / max(norms[r], 1e-12)))
        self.table = np.zeros((len(used) + 1, self.size), np.float32)
        for f, r, w in cells:
            self.table[f, r] += w
        for f, i in used.items():
            self.row_of[f] = i
        #: No landmark gets more than this from one occurrence of a feature.
        self.most = np.zeros(1 << 18, np.float32)
        for f, i in used.items():
            self.most[f] = self.table[i].max()
        self.landmarks = landmarks
        self.letters = _letter_bits(landmarks)
        self.seen: set[str] = set()
        self.near: dict[str, np.ndarray] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """Kernel of each word (its best window) with each landmark, FLOOR taken off; words x landmarks."""
        out = np.zeros((len(words), self.size), np.float32)
        if not words or not self.size:
            return out
        codes, owner = _codes(words)
        bound = np.zeros(len(codes))
        for row, feature, weight in _features(codes):
            bound += np.bincount(row, self.most[feature] * np.float32(weight), len(codes))
        rows = np.flatnonzero((bound > 0) & (bound >= FLOOR * _least_norms(codes)))
        for lo in range(0, len(rows), 1024):
            part = codes[rows[lo : lo + 1024]]
            dots = np.zeros((len(part), self.size), np.float32)
            for row, feature, weight in _features(part):
                at = self.row_of[feature]
                hit = at >= 0
                np.add.at(dots, row[hit], self.table[at[hit]] * np.float32(weight))
            values = np.maximum(dots / np.maximum(_norms(part), 1e-12)[:, None] - FLOOR, 0)
            np.maximum.at(out, owner[rows[lo : lo + 1024]], values)
        bits = _letter_bits(words)
        for j, landmark in enumerate(self.landmarks):
            for i in np.flatnonzero((bits & self.letters[j]) == self.letters[j]).tolist():
                span = _span(landmark, words[i])
                if span:
                    out[i, j] = max(out[i, j], (len(landmark) / span) ** HELD * (1 - FLOOR))
        return out

    def learn(self, words: set[str]) -> None:
        """Remember which of these words lie near a landmark, and how near."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.near.clear()
        fresh = list(words - self.seen)
        self.seen.update(fresh)
        for lo in range(0, len(fresh), 8192):
            part = fresh[lo : lo + 8192]
            values = self.of(part)
            for i in np.flatnonzero(values.any(axis=1)).tolist():
                self.near[part[i]] = values[i].copy()

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """For each text: nearest word, sum over words and share of words, for each landmark."""
        out = np.zeros((len(texts), 3, self.size), np.float32)
        for lo, hi in _runs(texts):
            counts = [Counter(letters_only(t)) for t in texts[lo:hi]]
            for words in _chunks(set().union(*counts), REMEMBERED // 2):
                self.learn(words)
                for i, count in enumerate(counts, lo):
                    hits = words & (count.keys() & self.near.keys())
                    if hits:
                        rows = np.array([self.near[w] for w in hits])
                        often = np.array([count[w] for w in hits], np.float32)
                        out[i, 0] = np.maximum(out[i, 0], rows.max(axis=0))
                        out[i, 1] += often @ rows
            for i, count in enumerate(counts, lo):
                out[i, 2] = np.minimum(out[i, 1] * (SHARE / max(1, count.total())), 4)
        out[:, 1] = np.log1p(out[:, 1])
        return out.reshape(len(texts), 3 * self.size)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > CHUNK_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _chunks(words: set[str], size: int) -> Iterator[set[str]]:
    if len(words) <= size:
        yield words
        return
    each = list(words)
    for lo in range(0, len(each), size):
        yield set(each[lo : lo + size])


@dataclass
class Model:
    """Landmark words, the Nyström map, the machine's weights, and the slope and shift of its probability."""

    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        margin = _mapped(pooled, self.whiten) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _mapped(pooled: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """The Nyström map, applied to each of the three poolings."""
    n = len(whiten)
    return np.hstack([pooled[:, k * n : (k + 1) * n] @ whiten for k in range(3)])


def in_training_fold(doc_id: Column) -> Column:
    """Never null: a row without an id is nobody's held-out row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def choose_landmarks(labelled: DataFrame, most: int = LANDMARKS) -> list[str]:
    """Words or stems that mark toxic documents best, by counts over all rows of labelled(text, label).

    Only the `most` * 8 best words reach the driver, cut to WINDOW letters; of these, near
    repeats are left out. Words of three letters and fewer are no landmarks.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\s]+", ""), r"\s+"), lambda w: F.length(w) > 3)
    stems = F.flatten(F.array(words, *[F.transform(F.filter(words, _longer(n)), _prefix(n)) for n in STEMS]))
    totals = labelled.agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    counts = labelled.select("label", F.explode(F.array_distinct(stems)).alias("word")).groupBy("word").agg(F.sum("label").alias("bad_df"), F.count("*").alias("df"))
    share = (F.col("bad_df") + 0.01) / (F.col("bad") + 1)
    other = (F.col("df") - F.col("bad_df") + 0.5) / (F.col("n") - F.col("bad") + 1)
    ranked = (
        counts.where(F.col("bad_df") >= LEAST_TOXIC).join(F.broadcast(totals))
        .where((F.col("bad_df") >= F.col("bad") * LEAST_SHARE) & (share > other * 4))
        .withColumn("gain", F.col("bad_df") / (F.col("bad") + 1) * F.log(share / other))
        .orderBy(F.desc("gain"), "word").limit(most * 8)
    )
    found = [r.word[:WINDOW] for r in ranked.select("word").collect()]
    found = list(dict.fromkeys(found))
    likeness = Kernel(found).of(found) if found else np.zeros((0, 0))
    kept: list[int] = []
    for i in range(len(found)):
        if len(kept) < most and not any(likeness[i, j] > ALIKE - FLOOR for j in kept):
            kept.append(i)
    return [found[i] for i in kept]


def _longer(n: int):
    return lambda w: F.length(w) > n


def _prefix(n: int):
    return lambda w: F.substring(w, 1, n)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the violated rows; the last weight is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (len(y) - y.sum()), 1)) * c
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = sign * (z @ w) < 1
        za = z[active] * cost[active, None]
        new = np.linalg.solve(ridge + za.T @ z[active], za.T @ sign[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with the usual softened targets."""
    good, bad = (y > 0).sum(), (y == 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        r = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(r * margin**2).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled(id, text, label); rows with a null label are left out.

    Landmark statistics use every row given (labelled_rows() gives at most FIT_ROWS); the
    machine is fitted on at most `fit_rows` of them, by hash order of the ids. Where nothing marks the toxic rows, the model scores
    every text as not toxic.
    """
    labelled = labelled.where("label is not null").select("id", "text", F.col("label").cast("int").alias("label"))
    words = choose_landmarks(labelled, landmarks)
    if not words:
        return Model([], np.zeros((0, 0)), np.zeros(1), 1.0, -4.0)  # nothing marks toxic texts

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(words)
        for batch in stream:
            pooled = kernel.pool(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in pooled], pa.binary()), batch.column(1)], ["pooled", "label"])

    sample = labelled.select("id").orderBy(F.xxhash64("id"), "id").limit(fit_rows).withColumnRenamed("id", "taken")
    rows = labelled.join(F.broadcast(sample), F.col("id") == F.col("taken"), "left_semi").select("text", "label").mapInArrow(batches, "pooled binary, label int").collect()
    x = np.array([np.frombuffer(r.pooled, np.float32) for r in rows], np.float64)
    y = np.array([r.label for r in rows])
    gram = Kernel(words).of(words).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-2 * np.eye(len(words)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-2))
    weights = _svm(_mapped(x, whiten), y)
    slope, shift = _platt(_mapped(x, whiten) @ weights[:-1] + weights[-1], y)
    return Model(words, whiten, weights, slope, shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add the probability of toxicity of each whole text.

    Null and empty texts get the score of a text without words; repeated rows and other
    columns pass through, but for one named like the output, which is replaced; an empty
    table stays empty.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out_col], T.StructField(out_col, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(model.landmarks)
        for batch in stream:
            at = lambda n: batch.column(batch.schema.get_field_index(n))
            values = model.scores(kernel.pool(at(text_col).to_pylist()).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*[at(n) for n in names], pa.array(values, pa.float64())], [*names, out_col])

    return docs.mapInArrow(batches, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, label) of at most `fit_rows` labelled rows of the training fold, a written table.

    The fold is the rows whose crc32 of the id modulo 3 is not 1. The sample is taken by
    hash order of the ids, from the labels alone, so that it is small enough to broadcast
    and no other text moves. A document with several labels counts as toxic if one says so.
    """
    held_in = labels.where(in_training_fold(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = held_in.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "labelled")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return materialize(texts.join(F.broadcast(sample), F.col("id") == F.col("labelled")).select("id", "text", "label"), "labelled-rows")
