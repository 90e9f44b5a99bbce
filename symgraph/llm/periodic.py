"""Periodic runs of words, found on a Re-Pair grammar of each document.

Documents are taken up in batches inside tasks; nothing crosses documents. Word ids of all
documents of a batch are one array, and every step works on the whole of it:

1. Re-Pair: in each round every pair of neighbouring symbols that stands at least twice in its
   document, and more often than the pairs it overlaps, becomes a nonterminal, wherever it
   stands. When no pair repeats, what is left of a document is paired into a balanced tree.
2. Each nonterminal's boundary is looked at once, at the nonterminal's first place: a run of
   12 or more words across it repeats three words on one side of the boundary, so the other
   places of these three words are the periods to try. How far a period holds is found by
   bisection over prefix hashes.
3. What was found is moved to all places of the nonterminal. A run is whole at the smallest
   nonterminal that holds it; parts seen in smaller ones lie inside it and are dropped.
4. Runs are compared with the words themselves. Where a hash has misled, the batch is done again
   without hashes, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that are taken up at once; a longer document is taken up alone.
SLICE = 8_000_000
#: Candidates that are compared at once.
CHUNK = 2_000_000
#: The shortest run that is looked for; three words on one side of a boundary repeat from 11 on.
LEAST = 12


def _rule_names(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each pair, occurrences of its kind), pairs in order of their symbols."""
    order = np.lexsort((right, left)) if len(left) and max(left.max(), right.max()) >= 1 << 31 else np.argsort((left << 32) | right, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (left[order[1:]] != left[order[:-1]]) | (right[order[1:]] != right[order[:-1]])
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(fresh) - 1
    return name, np.bincount(name, minlength=1)


def _every_other(same: np.ndarray) -> np.ndarray:
    """Of neighbours that are all marked: the first, third, and so on."""
    at = np.arange(len(same))
    first = np.maximum.accumulate(np.where(same & ~np.concatenate([[False], same[:-1]]), at, 0))
    return same & ((at - first) % 2 == 0)


class Grammar:
    """Places of the nonterminals that hold at least `least` words: rule, start, boundary, end."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, least: int = LEAST):
        self.least, self.rules, self.parts = least, 0, []
        if not len(words):
            return
        ends = np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]])) + 1
        self.end_of = np.zeros(doc[-1] + 1, np.int64)
        self.end_of[doc[ends - 1]] = ends
        symbol, _ = _rule_names(doc.astype(np.int64), words)  # one for each document and word
        self.rules = int(symbol.max()) + 1
        start, settled = np.arange(len(words)), []
        while len(symbol):
            chosen, name = self._choose(symbol, doc)
            busy = np.zeros(len(self.end_of), bool)
            busy[doc[chosen]] = True
            rest = ~busy[doc]
            if rest.any():
                settled.append((doc[rest], start[rest]))
            if not len(chosen):
                break
            after = np.concatenate([start[1:], [0]])
            _, rule = np.unique(name, return_inverse=True)
            self._record(self.rules + rule, start[chosen], start[chosen + 1], self._ends(doc, after)[chosen + 1])
            symbol = symbol.copy()
            symbol[chosen] = self.rules + rule
            self.rules += int(rule.max()) + 1
            keep = ~rest
            keep[chosen + 1] = False
            symbol, doc, start = symbol[keep], doc[keep], start[keep]
        self._tree(settled)

    def _ends(self, doc: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where each symbol ends: at the next of its document, or with the document."""
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        return np.where(last, self.end_of[doc], after)

    def _choose(self, symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs to replace in this round, and the pairs' numbers."""
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        if not len(pair):
            return pair, pair
        often = np.bincount(symbol)
        pair = pair[(often[symbol[pair]] > 1) & (often[symbol[pair + 1]] > 1)]
        same = np.zeros(len(symbol), bool)
        same[pair] = symbol[pair] == symbol[pair + 1]
        pair = pair[~same[pair] | _every_other(same)[pair]]
        if not len(pair):
            return pair, pair
        name, count = _rule_names(symbol[pair], symbol[pair + 1])
        rank = np.full(len(symbol) + 1, -1, np.int64)
        rank[pair] = np.where(count[name] > 1, count[name] * len(count) + name, -1)
        before = np.concatenate([[-1], rank[:-2]])
        won = (rank[:-1] >= 0) & (rank[:-1] > before) & (rank[:-1] > rank[1:])
        return np.flatnonzero(won), name[won[pair]]

    def _record(self, rule: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> None:
        long = end - start >= self.least
        if long.any():
            self.parts.append((rule[long], start[long], mid[long], end[long]))

    def _tree(self, settled: list) -> None:
        """Pair what is left of each document, level by level; each node is a rule of its own."""
        doc, start = (np.concatenate(x) for x in zip(*settled))
        order = np.argsort(start, kind="stable")
        doc, start = doc[order], start[order]
        while True:
            first = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(len(doc)), 0))
            odd = (np.arange(len(doc)) - first) % 2 == 1
            if not odd.any():
                return
            right = np.flatnonzero(odd)
            end = self._ends(doc, np.concatenate([start[1:], [0]]))
            self._record(self.rules + np.arange(len(right)), start[right - 1], start[right], end[right])
            self.rules += len(right)
            doc, start = doc[~odd], start[~odd]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All places, by rule, the first of a rule ahead."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        rule, start, mid, end = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((start, rule))
        return rule[order], start[order], mid[order], end[order]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit codes without structure."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Extensions:
    """How many words two places have in common, forwards and backwards."""

    def __init__(self, words: np.ndarray, exact: bool):
        self.words, self.exact = words, exact
        if not exact:
            self.power = np.cumprod(np.full(len(words) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64)) if len(words) else np.ones(1, np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words) * self.power[:-1])])

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i on hash as n from j on; i < j."""
        return (self.sums[i + n] - self.sums[i]) * self.power[j - i - 1] == self.sums[j + n] - self.sums[j]

    def _longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """The largest n up to most for which the n words after (sign 1) or before (-1) i and j agree."""
        got, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        step = 0
        while len(live) and (self.exact or step < 6):  # most places differ at once
            a, b = (i[live] + step, j[live] + step) if sign > 0 else (i[live] - step - 1, j[live] - step - 1)
            live = live[self.words[a] == self.words[b]]
            step += 1
            got[live] = step
            live = live[most[live] > step]
        low, high = got[live], most[live]
        a, b = i[live], j[live]
        while len(live) and (low < high).any():
            mid = (low + high + 1) >> 1
            fits = self._equal(a, b, mid) if sign > 0 else self._equal(a - mid, b - mid, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        got[live] = low
        return got

    def forwards(self, i, j, most):
        return self._longest(i, j, most, 1)

    def backwards(self, i, j, most):
        return self._longest(i, j, most, -1)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value of low <= value < high."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _by_weight(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbouring rows that weigh most together, or one heavier row."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _at_boundaries(ext: _Extensions, words: np.ndarray, doc: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, least: int):
    """(row, start, end, period) of what repeats across the boundaries, inside start and end."""
    n = len(words)
    codes = _mixed(words)
    triple = np.zeros(n, np.uint64)
    if n >= 3:
        triple[:-2] = _mixed((codes[:-2] * np.uint64(3) + codes[1:-1]) * np.uint64(5) + codes[2:])
    triple += _mixed(doc)
    if n >= 3:
        cut = np.concatenate([doc[2:] != doc[:-2], [True, True]])
    else:
        cut = np.ones(n, bool)
    at = np.flatnonzero(~cut)  # where three words of one document begin
    order = at[np.argsort(triple[at], kind="stable")]
    fresh = np.concatenate([[True], triple[order[1:]] != triple[order[:-1]]]) if len(order) else np.zeros(0, bool)
    group = np.full(n, -1, np.int64)
    group[order] = np.cumsum(fresh) - 1
    size = np.bincount(group[order], minlength=1)
    keys = group[order] * n + order  # ascending
    half, found = (end - start) // 2, []
    for back in (0, 3):
        anchor = mid - back
        use = (anchor >= start) & (anchor < n)
        use[use] = (group[anchor[use]] >= 0) & (size[group[anchor[use]]] > 1)
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        a, h = anchor[rows], half[rows]
        base = group[a] * n
        low = np.searchsorted(keys, base + np.maximum(start[rows], a - h), "left")
        high = np.searchsorted(keys, base + np.minimum(end[rows] - 1, a + h), "right")
        for part in _by_weight(high - low, CHUNK):
            row, place = _spread(low[part], high[part])
            row = rows[part][row]
            q = order[place] - anchor[row]
            row, q = row[q != 0], q[q != 0]
            first = np.where(q > 0, mid[row], mid[row] + q)
            q = np.abs(q)
            fits = (first >= start[row]) & (first + q <= end[row])
            row, q, first = row[fits], q[fits], first[fits]
            need = np.maximum(q, least - q)
            ahead = ext.forwards(first, first + q, end[row] - first - q)
            behind = ext.backwards(first, first + q, first - start[row])
            good = ahead + behind >= need
            found.append((row[good], (first - behind)[good], (first + q + ahead)[good], q[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def _least_periods(row, start, end, period):
    """One row for each (row, start, end): the one of the smallest period."""
    order = np.lexsort((period, end, start, row))
    row, start, end, period = row[order], start[order], end[order], period[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return row[first], start[first], end[first], period[first]


def _whole(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Without those that lie inside another of their period; each once, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        reach = period * (int(end.max()) + 1) + end
        before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]])
        start, end, period = start[reach > before], end[reach > before], period[reach > before]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _holds(words: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether all runs are what they are said to be, word by word, and cannot be longer."""
    for part in _by_weight(end - start, 4 * CHUNK):
        row, i = _spread(start[part], (end - period)[part])
        if (words[i] != words[i + period[part][row]]).any():
            return False
    n = len(words)
    inner = np.flatnonzero((start > 0) & (doc[start - 1] == doc[start]))
    if (words[start[inner] - 1] == words[start[inner] - 1 + period[inner]]).any():
        return False
    inner = np.flatnonzero(end < n)
    inner = inner[doc[end[inner]] == doc[start[inner]]]
    return not (words[end[inner]] == words[end[inner] - period[inner]]).any()


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs: stretches of at least `least` words and two periods that cannot be longer.

    words are ids from 0, doc the ascending number of each word's document; places count from
    the first word of all.
    """
    rule, start, mid, end = Grammar(words, doc, least).places()
    if not len(rule):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], rule[1:] != rule[:-1]]))
    upto = np.concatenate([first[1:], [len(rule)]])
    ext = _Extensions(words, exact)
    row, s, e, q = _least_periods(*_at_boundaries(ext, words, doc, start[first], mid[first], end[first], least))
    found = []
    for part in _by_weight((upto - first)[row], CHUNK):
        which, place = _spread(first[row[part]], upto[row[part]])
        shift = start[place] - start[first[row[part]]][which]
        found.append(_whole(s[part][which] + shift, e[part][which] + shift, q[part][which]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = _whole(*(np.concatenate(x) for x in zip(*found)))
    _, s, e, q = _least_periods(np.zeros(len(s), np.int64), s, e, q)
    if not exact and not _holds(words, doc, s, e, q):
        return runs_of(words, doc, least, exact=True)
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words between white space of ASCII, for each text."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    held = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    return held[offsets], words.filter(real)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _examine(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and the text without their repeats."""
    offsets, words = _words(texts.fill_null("").cast(pa.large_string()))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, period = runs_of(ids, doc, least)
    owner = doc[start]
    fields = [start - offsets[owner], end - start, period]
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(RUNS.value_type)),
    )
    depth = np.zeros(len(ids) + 1, np.int64)  # of repeats that lie over a word
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    keep = np.cumsum(depth[:-1]) == 0
    held = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lists = pa.LargeListArray.from_arrays(pa.array(held, pa.int64()), words.filter(pa.array(keep)))
    return runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, runs, collapsed) for every row: its periodic runs of words, and the text without their repeats.

    Words stand between white space of ASCII and count from 0. A run is a stretch of
    neighbouring words with smallest period q (words q apart are equal) of at least
    max(least, 2 q) words that cannot be longer. runs holds (start, length, period) by start and period;
    collapsed has the words that no run covers after its first q words, joined by one space. A null or
    empty text has no runs and an empty collapsed text; rows that repeat an id
    are each searched on their own; an empty table gives none; other columns are left out.
    """
    if least < 11:
        raise ValueError("runs of fewer than 11 words are not found by three words at a boundary")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1)
            weight = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for part in _by_weight(weight, SLICE):
                n = part.stop - part.start
                runs, collapsed = _examine(texts.slice(part.start, n), least)
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, n), runs, collapsed.cast(pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(batches, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
