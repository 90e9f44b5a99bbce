"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder walks each pre-token once. An Aho-Corasick automaton gives the longest token
at a position; it is taken if merging would keep it apart from the token before it (the
pair test below), else the next shorter token that is its prefix is tried, and where none
is left the previous token is taken back. The outcome equals that of applying the merges
in rank order.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens whose ids a worker remembers before it starts afresh.
REMEMBERED = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """All tokens' bytes in one run, and where each begins."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        size = 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in t)
        for a in spec["added_tokens"]:
            self.bytes_of[a["id"]] = a["content"].encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        where = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode("utf-8", "replace")


class Codec(Decoder):
    """Tables for encoding with one vocabulary file; built once in each Python worker."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        super().__init__(path)
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = len(self.bytes_of)
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: pair -> (rank, merged id); halves and rank of each merged token.
        self.merged = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.halves = {ids[a + b]: (ids[a], ids[b]) for a, b in reversed(merges)}
        self.rank = {ids[a + b]: rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        by_bytes = {raw[t]: i for t, i in ids.items()}
        self.shorter = [-1] * size
        for b, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1)
        self.words = by_bytes
        self.size = [len(b) for b in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for b, i in by_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        # Fixed value: the split that byte-level vocabularies of this kind are made with.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.seen: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Would merging leave the border between these two tokens alone?

        Both are unwound from their last merge back; a pair across the border that has a
        merge of a lower rank than what was unwound so far would have been merged first.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        top, ok = 1 << 60, True
        a, b = left, right
        while True:
            hit = self.merged.get((a, b))
            if hit is not None and hit[0] < top:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                # A merge in the left token with the right one's rank or above is undone first.
                top, a = ra, self.halves[a][1]
            else:
                # An equal rank further left wins, so the right token's own merge counts as later.
                top, b = rb + 1, self.halves[b][0]
        if len(self.fits) > 200_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def longest(self, data: str, at: int) -> int:
        """The longest token that starts at a position; every single byte is a token, so there is one."""
        return next(self.automaton.iter_long(data, at))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        if n == 1:
            return [self.words[piece]]
        data = piece.decode("latin-1")
        possible = bytearray(b"\x01" * (n + 1))
        first: dict[int, int] = {}  # only the positions that a token ends before are searched
        out: list[int] = []
        pos, token = 0, self.longest(data, 0)
        size, shorter, apart = self.size, self.shorter, self.apart
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if possible[end] and (last < 0 or apart(last, token)):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = first.get(pos, -1)
                        if token < 0:
                            token = first[pos] = self.longest(data, pos)
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                possible[pos] = 0
                token = out.pop()
                pos -= size[token]
                break
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.special_split(text) if self.special_split else [text]
        out = []
        seen = self.seen
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for piece in self.split(part):
                got = seen.get(piece)
                if got is None:
                    got = _packed(self.encode_piece(piece.encode()))
                    if len(piece) <= 64:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[piece] = got
                out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _map_column(df: DataFrame, source: str, target: str, kind: T.DataType, convert) -> DataFrame:
    """df with one more column, computed batch by batch."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != target], T.StructField(target, kind)])
    names = [f.name for f in schema.fields[:-1]]
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = convert()
        for batch in stream:
            values = batch.column(batch.schema.get_field_index(source))
            made = pa.array([apply(v.as_py()) for v in values], arrow)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], made], [*names, target])

    return df.mapInArrow(batches, schema)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Add the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    Strings of special tokens in a text become their ids. A null or empty text gives no
    ids; repeated rows and other columns pass through, but for one named like the output,
    which is replaced; an empty table stays empty.
    """
    path = vocabulary or default_vocabulary()

    def start():
        encoder = codec(path)
        return lambda text: encoder.encode(text or "")

    return _map_column(docs, text_col, out_col, T.BinaryType(), start)


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the text of packed ids, special tokens included; null ids give an empty text.

    A column named like the output is replaced; an empty table stays empty.
    """
    path = vocabulary or default_vocabulary()

    def start():
        table = decoder(path)
        return lambda ids: table.decode(ids or b"")

    return _map_column(encoded, ids_col, out_col, T.StringType(), start)
