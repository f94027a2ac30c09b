"""Byte-pair encoding with a public vocabulary, in linear time.

The vocabulary's tokens, read as Latin-1 text, form an Aho-Corasick automaton
that lists the tokens starting at each byte of a piece. A sequence of tokens
is what the merges would give exactly if each two neighbours are, so the
encoder takes the longest token that goes with the one before it, falls back
to shorter ones where none fits further on, and never visits a byte position
twice that turned out to lead nowhere. Which two tokens may stand side by side
is found by running the merges on the two once, and remembered.

Defined results: null and empty texts have no ids; special tokens' strings are
ordinary text; ids don't depend on batches or partitions.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encoder of one vocabulary file of base64 tokens and their ids."""

    def __init__(self, path: str, pattern: str = PATTERN, known: int = 500_000):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.lengths = {i: len(t) for t, i in self.ids.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.known = known
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def merges(self, data: bytes) -> list[int]:
        """The plain procedure: the earliest learned merge first. Quadratic; for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ids.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def side_by_side(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 4 * self.known:
                self.fits.clear()
            got = self.fits[key] = self.merges(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        starts: list[list[int]] = [[] for _ in data]
        for end, (i, n) in self.automaton.iter(data.decode("latin-1")):
            starts[end - n + 1].append(i)  # by rising end, so the longest is last
        out: list[int] = []
        left: list[int] = []  # untried tokens at each position on the way
        dead = bytearray(len(data) + 1)
        at, left_here = 0, len(starts[0])
        while at < len(data):
            while left_here:
                left_here -= 1
                token = starts[at][left_here]
                end = at + self.lengths[token]
                if not dead[end] and (not out or self.side_by_side(out[-1], token)):
                    out.append(token)
                    left.append(left_here)
                    at = end
                    left_here = len(starts[at]) if at < len(data) else 0
                    break
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.lengths[token]
                left_here = left.pop()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for p in self.split(text):
            got = pieces.get(p)
            if got is None:
                got = self.piece(p.encode())
                if len(p) <= 64:
                    if len(pieces) > self.known:
                        pieces.clear()
                    pieces[p] = got
            out += got
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One encoder of a vocabulary for each Python worker."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = Encoder(path, pattern)
    return _loaded[key]


def vocabulary(name: str, tokenizers: str = TOKENIZERS) -> str:
    return f"{tokenizers}/{name}.tiktoken"


def _each(path: str, pattern: str, finish: Callable[[pa.RecordBatch, list[list[int]]], pa.RecordBatch]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield finish(part, [code.encode(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()])

    return run


def _lists(batch: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])


def _sizes(batch: pa.RecordBatch, ids: list[list[int]]) -> pa.RecordBatch:
    rest = [batch.column(i) for i in range(batch.num_columns - 1)]
    return pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in ids], pa.int64())], names=[*batch.schema.names[:-1], "tokens"])


def token_ids(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(``id_col``, ids array<int>): the ids of each row's text; one row for each row of ``df``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_each(path or vocabulary("byte_bpe_50k"), pattern, _lists), f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def token_counts(df: DataFrame, keep: list[str], *, text_col: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the text."""
    rows = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_each(path or vocabulary("byte_bpe_50k"), pattern, _sizes), f"{schema}, tokens long")
