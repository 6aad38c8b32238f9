"""Search without gaps: of every diagonal on which a query and a target share a word, the best matching segment or the
whole overlap.

Texts are spread over blocks of a bounded number of letters, and every block of queries meets every block of targets in
a task, where words are joined and diagonals measured as arrays. So no pair of words is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_LETTERS = 1_000_000
#: Pairs of words, and letters of diagonals, that a task holds at once.
PAIRS_AT_ONCE = 500_000
LETTERS_AT_ONCE = 2_000_000

FOUND = "q binary, t binary, strand int, query_start int, query_end int, target_start int, target_end int, matches int, n int, query_length int"


def _coded(texts: list[str], unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts as 0 to 3 (others, and one place after each text: ``unknown``); where each begins; its length."""
    table = np.full(256, unknown, np.uint8)
    for n, letter in enumerate("ACGT"):
        table[ord(letter)] = n
    codes = table[np.frombuffer(("\n".join(texts) + "\n").encode("latin-1", "replace"), np.uint8)]
    size = np.array([len(x) for x in texts], np.int64)
    return codes, np.cumsum(size + 1) - size - 1, size


def _words(codes: np.ndarray, word: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the words without unknown letters."""
    n = len(codes) - word + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, good = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(word):
        part = codes[k : k + n]
        number = number * 4 + part
        good &= part < 4
    at = np.flatnonzero(good)
    return at, number[at]


def _best(match: np.ndarray, n: np.ndarray, least: int, identity: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``match`` with a segment of ``least`` letters or more and at least that identity; its begin and end.

    Of several segments the one of the highest score (2 for a match, -3 for a mismatch), the leftmost, then shortest.
    """
    width = match.shape[1]
    fine = np.zeros((len(match), width + 1), np.int32)  # a segment has the identity if this doesn't fall over it
    up, down = identity.denominator - identity.numerator, identity.numerator
    np.cumsum(match.astype(np.int32) * (up + down) - down, axis=1, out=fine[:, 1:])
    ends = np.where(np.arange(width + 1) <= n[:, None], fine, np.iinfo(np.int32).min)
    rows = np.flatnonzero((ends[:, least:] >= np.minimum.accumulate(fine, axis=1)[:, : width + 1 - least]).any(axis=1))
    fine, ends = fine[rows], ends[rows]
    score = np.zeros((len(rows), width + 1), np.int32)
    np.cumsum(match[rows].astype(np.int32) * 5 - 3, axis=1, out=score[:, 1:])
    most, begin, end = np.full(len(rows), np.iinfo(np.int32).min), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    every = np.arange(len(rows))
    for b in range(width + 1 - least if len(rows) else 0):
        gain = np.where(ends[:, b + least :] >= fine[:, b : b + 1], score[:, b + least :] - score[:, b : b + 1], np.iinfo(np.int32).min)
        e = gain.argmax(axis=1)
        better = gain[every, e] > most
        most = np.where(better, gain[every, e], most)
        begin, end = np.where(better, b, begin), np.where(better, b + least + e, end)
    return rows, begin, end


def _diagonals(q: tuple, t: tuple, word: int):
    """(query, target, shift) of the diagonals of shared words, in portions; one may come in several portions."""
    (qc, q0, _), (tc, t0, _) = q, t
    (qa, qn), (ta, tn) = _words(qc, word), _words(tc, word)
    order = np.argsort(tn, kind="stable")
    ta, tn = ta[order], tn[order]
    first = np.searchsorted(tn, qn)
    many = np.searchsorted(tn, qn, "right") - first
    qa, first, many = qa[many > 0], first[many > 0], many[many > 0]
    total, at = np.cumsum(many), 0
    while at < len(qa):
        to = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + PAIRS_AT_ONCE, "right")))
        m = many[at:to]
        a = np.repeat(qa[at:to], m)
        b = ta[np.repeat(first[at:to] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        new = (a == 0) | (b == 0) | (qc[a - 1] != tc[b - 1])  # later words of a run name the same diagonal
        a, b, at = a[new], b[new], to
        x, y = np.searchsorted(q0, a, "right") - 1, np.searchsorted(t0, b, "right") - 1
        yield np.unique(np.stack([x, y, (b - t0[y]) - (a - q0[x])]), axis=1)


def _segments(q: tuple, t: tuple, x: np.ndarray, y: np.ndarray, shift: np.ndarray, identity: Fraction, coverage: float):
    """The best segments of diagonals: rows of ``x`` in portions, begin and end in the query (from 0), matches."""
    begin = np.maximum(-shift, 0)
    n = np.minimum(q[2][x] - begin, t[2][y] - begin - shift)
    least = np.maximum(np.ceil(coverage * q[2][x] - 1e-9).astype(np.int64), 1)
    order = np.lexsort((n, least))
    order = order[n[order] >= least[order]]
    at = 0
    while at < len(order):
        size = least[order[at]]
        to = int(np.searchsorted(least[order], size, "right"))
        to = min(to, at + max(1, LETTERS_AT_ONCE // int(n[order[at:to]].max())))
        k, at = order[at:to], to
        place = np.arange(n[k].max())
        inside = place < n[k, None]
        a = np.where(inside, (q[1][x[k]] + begin[k])[:, None] + place, 0)
        b = np.where(inside, (t[1][y[k]] + begin[k] + shift[k])[:, None] + place, 0)
        match = (q[0][a] == t[0][b]) & inside
        rows, start, end = _best(match, n[k], int(size), identity)
        k = k[rows]
        hits = np.cumsum(match[rows], axis=1, dtype=np.int32)
        every = np.arange(len(rows))
        yield k, begin[k] + start, begin[k] + end, hits[every, end - 1] - np.where(start > 0, hits[every, start - 1], 0)


def _overlaps(q: tuple, t: tuple, x: np.ndarray, y: np.ndarray, shift: np.ndarray, identity: float, coverage: float):
    """As ``_segments``, but the whole overlaps that meet the limits."""
    begin = np.maximum(-shift, 0)
    n = np.minimum(q[2][x] - begin, t[2][y] - begin - shift)
    order = np.flatnonzero(n / q[2][x] >= coverage)
    total, at = np.cumsum(n[order]), 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, total[at] - n[order[at]] + LETTERS_AT_ONCE, "right")))
        k, at = order[at:to], to
        first = np.cumsum(n[k]) - n[k]
        place = np.arange(n[k].sum()) - np.repeat(first, n[k])
        a = np.repeat(q[1][x[k]] + begin[k], n[k]) + place
        b = np.repeat(t[1][y[k]] + begin[k] + shift[k], n[k]) + place
        matches = np.add.reduceat((q[0][a] == t[0][b]).astype(np.int64), first)
        good = matches / n[k] >= identity
        k = k[good]
        yield k, begin[k], begin[k] + n[k], matches[good]


def _meet(queries: list[str], targets: list[str], word: int, measure: Callable) -> pd.DataFrame:
    if not queries or not targets:
        queries, targets = [""], [""]
    t = _coded(targets, 5)
    forward = _coded(queries, 4)
    parts = []
    for strand in (1, -1):
        q = forward
        if strand < 0:
            flip = np.array([3, 2, 1, 0, 4], np.uint8)[forward[0]]
            q = (np.concatenate([np.append(flip[b : b + n][::-1], 4) for b, n in zip(forward[1], forward[2])]).astype(np.uint8), *forward[1:])
        for x, y, shift in _diagonals(q, t, word):
            for k, s, e, matches in measure(q, t, x, y, shift):
                parts.append(np.stack([x[k], y[k], np.full(len(k), strand), s + 1, e, s + shift[k] + 1, e + shift[k], matches, e - s, q[2][x[k]]]))
    out = np.unique(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((10, 0), np.int64)
    return pd.DataFrame(dict(zip([c.split()[0] for c in FOUND.split(", ")], out)))


def search_segments(queries: DataFrame, targets: DataFrame, word: int = 12, min_identity: float = 0.8, min_coverage: float = 0.15, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Local search of queries in targets, on both strands: per diagonal with a shared word its best segment.

    On each diagonal on which a query and a target share a word, all segments of at least ``min_identity`` that hold at
    least ``min_coverage`` of the query count; the one that scores best (2 for a match, -3 for a mismatch) is given, the
    leftmost if scores are equal. So a diagonal is given if and only if it has such a segment. Letters other than A, C,
    G and T (in either case) are unknown: they match nothing, not even themselves, and are in no word.

    Args:
        queries: ``query_id`` and ``query`` (sequence). targets: ``target_id`` and ``sequence``. Texts up to some
            thousand letters: a diagonal that is given is measured in squared time.
        word: letters of a shared word, at most 31.
        block_letters: about the most letters of one side that a task holds. Every block of queries meets every block
            of targets, so texts are copied once for each block of the other side.

    Returns:
        ``query_id, target_id, strand, query_start, query_end, target_start, target_end`` (1-based, both included; of
        the query's strand), ``matches``, ``identity`` and ``coverage`` of the segment. Equal texts are searched once.
    """
    exact = Fraction(min_identity).limit_denominator(10_000)
    return _search(queries, targets, word, lambda *on: _segments(*on, exact, min_coverage), block_letters)


def search_words(queries: DataFrame, targets: DataFrame, word: int = 12, min_identity: float = 0.8, min_coverage: float = 0.15, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """Search of queries in targets, on both strands: per diagonal with a shared word the whole overlap.

    The query is laid along each diagonal on which it shares a word with the target; it is given if the overlap has at
    least ``min_identity`` and holds at least ``min_coverage`` of the query. A match inside an overlap that is otherwise
    unlike is lost: ``search_segments`` finds it. Letters, arguments and columns are as there. A null id takes no part;
    null and empty texts share no word; repeated rows are one.
    """
    return _search(queries, targets, word, lambda *on: _overlaps(*on, min_identity, min_coverage), block_letters)


def _search(queries: DataFrame, targets: DataFrame, word: int, measure: Callable, block_letters: int) -> DataFrame:
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    qs = queries.select("query_id", F.upper("query").alias("text")).where("query_id is not null and length(text) > 0").distinct().withColumn("key", key)
    ts = targets.select("target_id", F.upper("sequence").alias("text")).where("target_id is not null and length(text) > 0").distinct().withColumn("key", key)

    def blocks(df: DataFrame) -> int:
        return max(1, -(-(df.agg(F.sum(F.length("text"))).first()[0] or 0) // block_letters))

    q, t = qs.select("key", "text").distinct(), ts.select("key", "text").distinct()
    a, b = blocks(q), blocks(t)

    def spread(df: DataFrame, own: int, other: int, tile, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("text"), F.lit(own))
        rows = df.select("key", "text", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("theirs"))
        return rows.select(tile(F.col("mine"), F.col("theirs")).cast("int").alias("tile"), F.lit(side).alias("side"), "key", "text")

    tiles = spread(q, a, b, lambda m, o: m * b + o, 0).unionByName(spread(t, b, a, lambda m, o: o * b + m, 1))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = (rows[rows["side"] == n] for n in (0, 1))
        found = _meet(mine["text"].tolist(), theirs["text"].tolist(), word, measure)
        found["q"], found["t"] = mine["key"].to_numpy()[found["q"]], theirs["key"].to_numpy()[found["t"]]
        return found

    found = tiles.repartition(a * b, "tile").groupBy("tile").applyInPandas(meet, FOUND)
    named = found.join(qs.select("query_id", F.col("key").alias("q")), "q").join(ts.select("target_id", F.col("key").alias("t")), "t")
    return named.select(
        "query_id", "target_id", "strand", "query_start", "query_end", "target_start", "target_end", "matches",
        (F.col("matches") / F.col("n")).alias("identity"), (F.col("n") / F.col("query_length")).alias("coverage"),
    )
