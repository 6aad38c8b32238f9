"""Short ungapped alignments between two sequences or within one: seeds, extension, overlap elimination.

One narrow pass over the pairs: nothing is shuffled, and every column of a pair stays with its matches. The pairs of an Arrow
batch are handled together as arrays, those of many letters in smaller portions. Seeds are found by sorted words, never by
comparing all positions. With k mismatches allowed, a word is cut into k + 1 blocks, one of which must be equal; candidates
meet on (pair, block) and are then counted. Positions count from 0. Orientations: 0 forward, 1 reverse complement.

An extension takes one letter more to the right of both sequences, as long as the whole window has at most k
mismatches, then to the left. For the reverse complement the second window is compared as a whole after turning it,
so such matches rarely grow; that is how the rule is defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import COMPLEMENT, PLAIN, mismatch_positions, reverse_complement

ORIENTATIONS = ("forward", "reverse_complement")
#: Letters of pairs, and candidates or letters of windows, that are looked at together.
LETTERS, TOGETHER = 1 << 18, 1 << 20
_TURN = str.maketrans(PLAIN, COMPLEMENT)


@dataclass(frozen=True)
class Finder:
    """What counts as a match. Distances apply within one sequence only."""

    min_length: int = 9
    max_mismatches: int = 0
    check_forward: bool = True
    check_revcomp: bool = True
    min_distance: int = 0
    max_distance: int | None = None

    def __post_init__(self) -> None:
        if self.min_length < 1 or self.max_mismatches < 0 or self.min_distance < 0:
            raise ValueError("min_length must be positive, max_mismatches and min_distance not negative")
        if self.max_mismatches >= self.min_length:
            raise ValueError("max_mismatches must be less than min_length")
        if not (self.check_forward or self.check_revcomp):
            raise ValueError("at least one orientation must be checked")
        if self.max_distance is not None and self.max_distance < self.min_distance:
            raise ValueError("max_distance must not be less than min_distance")


class Pairs:
    """The sequences of pairs as arrays of small numbers: first, second, and second turned, one after another."""

    def __init__(self, first: list[str], second: list[str]):
        texts = [*first, *second, *(t[::-1].translate(_TURN) for t in second)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int64)
        self.bits = max(1, int(letters.size - 1).bit_length())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        n = len(first)
        self.size = (sizes[:n], sizes[n : 2 * n])
        #: Where each pair's first sequence begins, its second one, and that turned.
        self.at = (begins[:n], begins[n : 2 * n], begins[2 * n :])

    def words(self, width: int) -> np.ndarray:
        """A number for the word of that width at each place: equal exactly if the words are."""
        per = 63 // self.bits
        n = max(0, self.codes.size - width + 1)
        out = None
        for begin in range(0, width, per):
            part = np.zeros(n, np.int64)
            for k in range(begin, min(begin + per, width)):
                part = part << self.bits | self.codes[k : k + n]
            if out is None:
                out = part
            else:
                first, second = (np.unique(x, return_inverse=True)[1] for x in (out, part))
                out = first * (int(second.max(initial=0)) + 1) + second
        return out

    def places(self, side: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The pair and the position of every word of the first (0) or second (1) sequences."""
        many = np.maximum(self.size[side] - width + 1, 0)
        row = np.repeat(np.arange(many.size), many)
        return row, np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)

    def second(self, row: np.ndarray, j: np.ndarray, n: np.ndarray | int, o: int) -> np.ndarray:
        """Where the window of n letters at j of the second sequence begins, turned for the reverse complement."""
        return self.at[2][row] + self.size[1][row] - j - n if o else self.at[1][row] + j

    def unlike(self, row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, o: int) -> np.ndarray:
        """Mismatches of windows of n letters."""
        out = np.zeros(row.size, np.int64)
        most = int(n.max(initial=1))
        a, b, step = self.at[0][row] + i, self.second(row, j, n, o), np.arange(most)
        for k in range(0, row.size, max(1, TOGETHER // most)):
            part = slice(k, k + max(1, TOGETHER // most))
            inside = step < n[part, None]
            x, y = (np.where(inside, at[part, None] + step, 0) for at in (a, b))
            out[part] = ((self.codes[x] != self.codes[y]) & inside).sum(axis=1)
        return out


def _met(key1: np.ndarray, key2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal keys, in portions."""
    order = np.argsort(key2, kind="stable")
    ordered = key2[order]
    first = np.searchsorted(ordered, key1)
    many = np.searchsorted(ordered, key1, "right") - first
    own = np.flatnonzero(many)
    first, many = first[own], many[own]
    total, at = np.cumsum(many), 0
    while at < own.size:
        to = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + TOGETHER, "right")))
        m = many[at:to]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(own[at:to], m), order[np.repeat(first[at:to], m) + inner]
        at = to


def _blocks(finder: Finder) -> list[tuple[int, int]]:
    """Begin and length of the blocks of a word, one of which any acceptable match leaves unchanged."""
    parts = finder.max_mismatches + 1
    edges = [finder.min_length * p // parts for p in range(parts + 1)]
    return [(edges[p], edges[p + 1] - edges[p]) for p in range(parts)]


def _seeds(pairs: Pairs, finder: Finder, o: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with at most the allowed mismatches: pair, and positions in both sequences.

    Of forward seeds without mismatches that follow each other on a diagonal, which grow into one match, only the first.
    """
    w, k = finder.min_length, finder.max_mismatches
    row1, i = pairs.places(0, w)
    row2, j = pairs.places(1, w)
    a, b = pairs.at[0][row1] + i, pairs.second(row2, j, w, o)
    found = []
    for at, n in _blocks(finder):
        words = pairs.words(n)
        known, number = np.unique(np.r_[words[a + at], words[b + at]], return_inverse=True)
        key = np.r_[row1, row2] * max(1, known.size) + number
        for x, y in _met(key[: a.size], key[a.size :]):
            if within:
                apart = j[y] - i[x]
                most = np.iinfo(np.int64).max if finder.max_distance is None else finder.max_distance
                good = (apart >= max(finder.min_distance, w)) & (apart <= most)
                x, y = x[good], y[good]
            if k:
                good = pairs.unlike(row1[x], i[x], j[y], np.full(x.size, w), o) <= k
                x, y = x[good], y[good]
            elif not o:
                good = (i[x] == 0) | (j[y] == 0) | (pairs.codes[a[x] - 1] != pairs.codes[b[y] - 1])
                x, y = x[good], y[good]
            found.append(np.stack([row1[x], i[x], j[y]]))
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return tuple(np.unique(out, axis=1) if k and out.size else out)


def _grown(pairs: Pairs, row: np.ndarray, i: np.ndarray, j: np.ndarray, finder: Finder, o: int) -> tuple[np.ndarray, ...]:
    """Where seeds grown right, then left begin, their lengths and mismatches."""
    n = np.full(row.size, finder.min_length)
    wrong = pairs.unlike(row, i, j, n, o) if finder.max_mismatches else np.zeros(row.size, np.int64)
    p, q = i.copy(), j.copy()
    for to_left in (False, True):
        room = np.minimum(p, q) if to_left else np.minimum(pairs.size[0][row] - p, pairs.size[1][row] - q) - n
        on, step = np.flatnonzero(room > 0), 0
        while on.size:
            step += 1
            s, t = (p[on] - 1, q[on] - 1) if to_left else (p[on], q[on])
            if o:
                m = pairs.unlike(row[on], s, t, n[on] + 1, o)
            else:
                ahead = 0 if to_left else n[on]
                m = wrong[on] + (pairs.codes[pairs.at[0][row[on]] + s + ahead] != pairs.codes[pairs.at[1][row[on]] + t + ahead])
            fits = m <= finder.max_mismatches
            on, s, t, m = on[fits], s[fits], t[fits], m[fits]
            p[on], q[on], wrong[on] = s, t, m
            n[on] += 1
            on = on[room[on] > step]
    return p, q, n, wrong


def _kept(row, o, i, j, p, q, n, m) -> np.ndarray:
    """Of each pair's matches, longest and cleanest first, those that overlap no kept one of their orientation on both sequences.

    Equally good ones are taken in the order of their seeds: by i, forward before reverse, by j. In every round the best match
    left of each pair is kept, and what overlaps it is dropped.
    """
    left = np.lexsort((q, p, j, o, i, m, -n, row))
    kept = []
    while left.size:
        begins = np.flatnonzero(np.r_[True, row[left][1:] != row[left][:-1]])
        best = left[begins]
        kept.append(best)
        y = np.repeat(best, np.diff(np.r_[begins, left.size]))
        clash = (o[left] == o[y]) & (p[left] < p[y] + n[y]) & (p[y] < p[left] + n[left]) & (q[left] < q[y] + n[y]) & (q[y] < q[left] + n[left])
        left = left[~clash]
    return np.sort(np.concatenate(kept)) if kept else left


def _matches(first: list[str], second: list[str], finder: Finder, within: bool) -> tuple[np.ndarray, ...]:
    """The kept matches of these pairs: pair, orientation, begin in both sequences, length, mismatches."""
    pairs = Pairs(first, second)
    found = []
    for o, wanted in enumerate((finder.check_forward, finder.check_revcomp)):
        if wanted and pairs.codes.size >= finder.min_length:
            row, i, j = _seeds(pairs, finder, o, within)
            found.append(np.stack([row, np.full(row.size, o), i, j, *_grown(pairs, row, i, j, finder, o)]))
    row, o, i, j, p, q, n, m = np.concatenate(found, axis=1) if found else np.zeros((8, 0), np.int64)
    # One of each grown match, with its first seed.
    order = np.lexsort((j, i, m, n, q, p, o, row))
    same = [x[order] for x in (row, o, p, q, n, m)]
    order = order[np.r_[True, np.any([x[1:] != x[:-1] for x in same], axis=0)]] if order.size else order
    own = [x[order] for x in (row, o, i, j, p, q, n, m)]
    k = _kept(*own)
    return tuple(own[c][k] for c in (0, 1, 4, 5, 6, 7))


_MADE = ("the o", "the p1", "the p2", "the n", "the m")
RESULT = ("pos1", "pos2", "length", "orientation", "mismatches", "mismatch_positions", "seq1", "seq2")


def align_pairs(pairs: DataFrame, finder: Finder = Finder(), within: bool = False) -> DataFrame:
    """Alignments of pairs as rows with all columns of their pair, and those of RESULT, which replace columns of these names.

    ``pairs`` has ``s1`` and ``s2`` (any case; they stay as they are). Pairs with a null or short sequence have no row.
    """
    rows = pairs.drop(*RESULT)
    names = rows.columns
    rows = rows.where((F.length("s1") >= finder.min_length) & (F.length("s2") >= finder.min_length))
    rows = rows.withColumns({"the s1": F.upper("s1"), "the s2": F.upper("s2")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("the s1").to_pylist(), batch.column("the s2").to_pylist()
            begin, size = 0, 0
            for end, (a, b) in enumerate(zip(first, second), 1):
                size += len(a) + len(b)
                if size < LETTERS and end < len(first):
                    continue
                row, *made = _matches(first[begin:end], second[begin:end], finder, within)
                if row.size:
                    own = batch.take(pa.array(row + begin))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(x.astype(np.int32)) for x in made]], [*batch.schema.names, *_MADE])
                begin, size = end, 0

    shape = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{c}` int" for c in _MADE])
    found = rows.mapInArrow(run, shape)
    o, p, q, n, m = (F.col(c) for c in _MADE)
    own, raw = F.substring("the s1", p + 1, n), F.substring("the s2", q + 1, n)
    turned = F.when(o == 1, reverse_complement(raw)).otherwise(raw)
    where = F.when(m == 0, F.array().cast("array<int>")).otherwise(mismatch_positions(own, turned))
    way = F.element_at(F.array(*map(F.lit, ORIENTATIONS)), o + 1)
    made = (p, q, n, way, m, where, own, raw)
    return found.select(*[f"`{c}`" for c in names], *[c.alias(name) for c, name in zip(made, RESULT)])


def find_between(pairs: DataFrame, finder: Finder = Finder()) -> DataFrame:
    """Alignments between the two sequences of every pair.

    Args:
        pairs: ``pair_id`` (unique), ``s1`` and ``s2`` (any case); other columns are ignored.

    Returns:
        ``pair_id, pos1, pos2, length, orientation, mismatches, mismatch_positions, seq1, seq2``; seq2 as it stands
        in s2. Pairs with a null id, or a null or short sequence, have none. N matches only N.
    """
    rows = pairs.where(F.col("pair_id").isNotNull()).select("pair_id", "s1", "s2")
    return align_pairs(rows, finder).select("pair_id", *RESULT)


def find_within(sequences: DataFrame, finder: Finder = Finder()) -> DataFrame:
    """Alignments of each sequence with itself, the second window beginning ``min_length`` or more behind the first.

    Args:
        sequences: ``pair_id`` (unique) and ``seq``; other columns are ignored.

    Returns:
        As ``find_between``, with ``distance`` = pos2 - pos1.
    """
    rows = sequences.where(F.col("pair_id").isNotNull()).select("pair_id", F.col("seq").alias("s1"), F.col("seq").alias("s2"))
    return align_pairs(rows, finder, within=True).select("pair_id", *RESULT, (F.col("pos2") - F.col("pos1")).alias("distance"))
