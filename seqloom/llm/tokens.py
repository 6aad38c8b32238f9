"""Token counts with a public byte-level tokenizer, whose vocabulary file is read in every Python worker.

A text's tokens are those of the tokenizer, with one exception: a run of one kind of characters (letters, digits, marks or
white space) that reaches over a multiple of GRID bytes of its text and CLEAR bytes beyond is tokenized in two parts there.
So the tokens of any stretch between two ``edge`` places can be found from that stretch alone, and texts of any length
and make can be tokenized.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; every operator takes the path as a parameter.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern by which this family of tokenizers cuts a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GRID, CLEAR = 65_536, 2_048
#: Places at which no match of the pattern can go on, whatever stands before and behind.
_EDGE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


class Held:
    """A text of ``size`` bytes of which any stretch can be read: here one that is in memory."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.size = data, len(data)

    def get(self, begin: int, end: int) -> bytes:
        return bytes(self.data[begin:end])


def first_edge(text: Held, begin: int, stop: int) -> int | None:
    """The first place from ``begin`` to ``stop`` at which matches end, as a byte offset."""
    width = 256
    while begin <= stop:
        first = max(0, begin - 4)
        window = text.get(first, min(text.size, begin + width + 4))
        skip = next((i for i, b in enumerate(window[:4]) if b & 0xC0 != 0x80), 0)
        piece = window[skip:].decode("utf-8", "ignore")
        at, done = first + skip, 0
        for m in _EDGE.finditer(piece):
            at += len(piece[done : m.start()].encode())
            done = m.start()
            if at >= begin:
                return at if at <= stop else None
        begin, width = begin + width, 4096
    return None


def edge(text: Held, at: int) -> int:
    """The first place from ``at`` on at which the tokens before and behind don't depend on each other."""
    if at <= 0 or at >= text.size:
        return max(0, min(at, text.size))
    grid = -(-at // GRID) * GRID
    stop = min(text.size, grid + CLEAR)
    found = first_edge(text, at, stop)
    if found is not None or stop == text.size:
        return text.size if found is None else found
    return grid + next(i for i, b in enumerate(text.get(grid, grid + 4)) if b & 0xC0 != 0x80)


def forced(text: Held, begin: int, end: int) -> list[int]:
    """The places between these two at which a run is tokenized in two parts."""
    grids = range(-(-max(begin, 1) // GRID) * GRID, end, GRID)
    found = [edge(text, g) for g in grids if first_edge(text, g, min(text.size, g + CLEAR)) is None and g + CLEAR < text.size]
    return [at for at in found if begin < at < end]


class Tokenizer:
    """Token ids of texts, and the number of bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: t for t, i in ranks.items()}
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.widest = int(self.widths.max())

    def _parts(self, text: str) -> list[list[int]]:
        """The ids of a text, in the parts in which it is to be tokenized."""
        if len(text) <= GRID // 4:
            return [self.encoding.encode_ordinary(text)]
        data = text.encode()
        return self._cut(data, forced(Held(data), 0, len(data)))

    def _cut(self, data: bytes, cuts: list[int]) -> list[list[int]]:
        ends = [0, *cuts, len(data)]
        return [self.encoding.encode_ordinary(data[a:b].decode()) for a, b in zip(ends, ends[1:])]

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(p, np.int32) for p in self._parts(text)])

    def ids_between(self, data: bytes, cuts: list[int]) -> np.ndarray:
        """The ids of a stretch of a text, which is tokenized in parts at these places."""
        return np.concatenate([np.array(p, np.int32) for p in self._cut(data, cuts)])

    def count(self, text: str) -> int:
        return sum(map(len, self._parts(text)))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (int) of every row, in one narrow pass; a null text has 0 tokens."""
    rows = df.select(*keep, F.col(text).alias("the text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            sizes = [own.count(t.as_py()) if t.is_valid else 0 for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32())], [*keep, "n_tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens int"]))
