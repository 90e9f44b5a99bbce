"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each leaf block has features from the tags and names around it and from its text; the
chain's two states are main text and the rest. Weights are learned from labelled pages,
and Viterbi decoding picks the best sequence for a page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from symgraph.llm.html_blocks import Block, leaf_blocks
from symgraph.llm.labelled_pages import labelled_pages

#: Labelled pages that the field is fitted on.
FIT_PAGES = 700


def _bucket(n: int) -> int:
    return min(6, n.bit_length() // 2)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold at each block."""
    out = []
    for b in blocks:
        words = b.text.split()
        density = min(4, 4 * b.linked // max(1, len(b.text)))
        own = b.last[-1] if b.last else ""
        found = ["bias", f"own:{own}", f"links:{density}", f"words:{_bucket(len(words))}", f"ends:{b.text[-1] in '.!?…。'}", f"own:{own}:links:{density}", f"links:{density}:words:{_bucket(len(words))}"]
        found += [f"in:{t}" for t in b.tags] + [f"name:{n}" for n in b.names] + [f"near:{t}" for t in set(b.last)]
        found += ["way:" + ">".join(b.way), "outer:" + ">".join(b.way[:1])]
        if "©" in b.text or words and words[0].lower() == "copyright":
            found.append("copyright")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            found.append("separators")
        out.append(found)
    return out


@dataclass
class Field:
    """Weights of each feature for both states, and of each step between states."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: is each block main text?"""
        (rr, rm), (mr, mm) = self.steps
        rest = main = 0.0
        back = []
        get = self.weights.get
        for i, names in enumerate(features(blocks)):
            a = b = 0.0
            for n in names:
                w = get(n)
                if w is not None:
                    a += w[0]
                    b += w[1]
            if i:
                to_rest, to_main = rest + rr >= main + mr, rest + rm >= main + mm
                back.append((to_rest, to_main))
                rest, main = (rest + rr if to_rest else main + mr) + a, (rest + rm if to_main else main + mm) + b
            else:
                rest, main = a, b
        state = main > rest
        out = [state]
        for to_rest, to_main in reversed(back):
            state = not (to_main if state else to_rest)
            out.append(state)
        return out[::-1] if blocks else []


@lru_cache(4)
def train(pages: int = FIT_PAGES, rounds: int = 12, seed: int = 7, decay: float = 1e-3) -> Field:
    """Fit on labelled pages by adaptive gradient steps on the conditional likelihood; the same in every run, and fitted once in a process."""
    cases, index = [], {}
    for html in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        ids = [np.array([index.setdefault(n, len(index)) for n in names]) for names in features(blocks)]
        cases.append((ids, np.array([int(b.mark == "main") for b in blocks])))
    w, s = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gs = np.full_like(w, 1e-6), np.full_like(s, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for at in order.permutation(len(cases)):
            ids, gold = cases[at]
            if not len(ids):
                continue
            local = np.array([w[i].sum(axis=0) for i in ids])
            n = len(ids)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = local[0]
            for t in range(1, n):
                ahead[t] = local[t] + np.logaddexp(ahead[t - 1, 0] + s[0], ahead[t - 1, 1] + s[1])
            for t in range(n - 2, -1, -1):
                beyond = behind[t + 1] + local[t + 1]
                behind[t] = np.logaddexp(s[:, 0] + beyond[0], s[:, 1] + beyond[1])
            total = np.logaddexp(*ahead[-1])
            slope = np.exp(ahead + behind - total)
            slope[np.arange(n), gold] -= 1
            moved = s * decay
            for t in range(1, n):
                moved = moved + np.exp(ahead[t - 1][:, None] + s + (local[t] + behind[t])[None] - total)
                moved[gold[t - 1], gold[t]] -= 1
            flat = np.concatenate(ids)
            grad = np.zeros_like(w)
            np.add.at(grad, flat, np.repeat(slope, [len(i) for i in ids], axis=0))
            used = np.unique(flat)
            grad[used] += decay * w[used]
            gw[used] += grad[used] ** 2
            w[used] -= 0.3 * grad[used] / np.sqrt(gw[used])
            gs += moved**2
            s -= 0.3 * moved / np.sqrt(gs)
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in index.items()}, tuple(tuple(map(float, r)) for r in s))


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html)
    return " ".join(b.text for b, keep in zip(blocks, field.decode(blocks)) if keep)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", field: Field | None = None) -> DataFrame:
    """Add the main text of each whole page.

    A null or empty page, or one without main text, gives an empty text; broken markup is
    read as far as it goes. Repeated rows and other columns pass through (a column named
    like the output is replaced); an empty table stays empty.
    """
    field = field or train()
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != out_col or f.name == html_col], T.StructField(out_col, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = lambda n: batch.column(batch.schema.get_field_index(n))
            texts = pa.array([main_text(h.as_py(), field) for h in at(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[at(n) for n in names], texts], [*names, out_col])

    return pages.mapInArrow(batches, schema)
