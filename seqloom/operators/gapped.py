"""Gapped extension of seeds with affine gap costs, for whole Arrow batches at once.

The windows before and behind a seed are aligned to their full length: their near ends are free, the far ends are
forced. All alignments of a batch are computed together, cell by cell over the windows, so that the work is done by
array operations whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import PLAIN, COMPLEMENT

_TURN = str.maketrans(PLAIN, COMPLEMENT)
FAR = -(10**6)
#: Rows that are aligned together.
TOGETHER = 512


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = -1
    gap_open: int = -3
    gap_extend: int = -1


def align_windows(first: list[str], second: list[str], score: Scoring = Scoring()) -> list[tuple[str, str]]:
    """Each pair of windows aligned over its whole length, gaps as '-'. A pair with an empty window gives ('', '').

    A gap of n letters costs gap_open + n * gap_extend. Of equally good ways a match is taken before a letter of the
    first window alone, that before one of the second alone; a gap goes on rather than begins.
    """
    a_len, b_len = np.array([len(x) for x in first]), np.array([len(x) for x in second])
    rows, cols, many = int(a_len.max(initial=0)), int(b_len.max(initial=0)), len(first)
    if not rows or not cols:
        return [("", "")] * many
    pad = lambda xs, n, fill: np.array([list(x.encode("latin-1", "replace")) + [fill] * (n - len(x)) for x in xs], np.int16)
    a, b = pad(first, rows, -1), pad(second, cols, -2)
    equal = np.where(a[:, :, None] == b[:, None, :], score.match, score.mismatch).astype(np.int32)
    start = score.gap_open + score.gap_extend
    # Best scores that end in a pair, in a letter of the first alone, of the second alone.
    pair = np.zeros((rows + 1, cols + 1, many), np.int32)
    up = np.full_like(pair, FAR)
    side = np.full_like(pair, FAR)
    side[1:, 0] = (score.gap_open + score.gap_extend * np.arange(1, rows + 1))[:, None]
    up[0, 1:] = (score.gap_open + score.gap_extend * np.arange(1, cols + 1))[:, None]
    side[0, 0], up[0, 0] = FAR, 0
    for i in range(1, rows + 1):
        up[i, 1:] = np.maximum(pair[i - 1, 1:] + start, up[i - 1, 1:] + score.gap_extend)
        before = np.maximum(np.maximum(pair[i - 1, :-1], up[i - 1, :-1]), side[i - 1, :-1])
        pair[i, 1:] = before + equal[:, i - 1].T
        for j in range(1, cols + 1):
            side[i, j] = np.maximum(pair[i, j - 1] + start, side[i, j - 1] + score.gap_extend)
    return [_trace(n, first[n], second[n], pair, up, side, equal, score) if first[n] and second[n] else ("", "") for n in range(many)]


def _trace(n, a, b, pair, up, side, equal, score) -> tuple[str, str]:
    i, j = len(a), len(b)
    ends = (pair[i, j, n], up[i, j, n], side[i, j, n])
    state = ends.index(max(ends))
    top, low = [], []
    while (i and j and state == 0) or (i and state == 1) or (j and state == 2):
        if state == 0:
            i, j = i - 1, j - 1
            top.append(a[i])
            low.append(b[j])
            came = pair[i + 1, j + 1, n] - equal[n, i, j]
            state = 0 if pair[i, j, n] == came else 1 if up[i, j, n] == came else 2
        elif state == 1:
            goes_on = up[i - 1, j, n] == up[i, j, n] - score.gap_extend
            i -= 1
            top.append(a[i])
            low.append("-")
            state = 1 if goes_on else 0
        else:
            goes_on = side[i, j - 1, n] == side[i, j, n] - score.gap_extend
            j -= 1
            top.append("-")
            low.append(b[j])
            state = 2 if goes_on else 0
    top += [*a[:i][::-1], *"-" * j]
    low += [*"-" * i, *b[:j][::-1]]
    return "".join(reversed(top)), "".join(reversed(low))


EXTENDED = (
    "pos1 int, pos2 int, end1 int, end2 int, length1 int, length2 int, seq1_aligned string, seq2_aligned string, "
    "alignment_length int, matches int, mismatches int, gaps int, identity double, alignment_string string"
)


def extend_batch(rows: pd.DataFrame, reach: int, score: Scoring) -> pd.DataFrame:
    """Gapped alignments of a batch with columns s1, s2, pos1, pos2, length, orientation."""
    work = []
    for s1, s2, p1, p2, n, way in zip(*[rows[c] for c in ("s1", "s2", "pos1", "pos2", "length", "orientation")]):
        s1, s2 = s1.upper(), s2.upper()
        turned = way == "reverse_complement"
        t = s2[::-1].translate(_TURN) if turned else s2
        w = len(s2) - p2 - n if turned else p2
        core2 = s2[p2 : p2 + n]
        work.append((s1[max(0, p1 - reach) : p1][::-1], t[max(0, w - reach) : w][::-1], s1[p1 + n : p1 + n + reach], t[w + n : w + n + reach],
                     s1[p1 : p1 + n], core2[::-1].translate(_TURN) if turned else core2, p1, p2, n, w, len(s2), turned))
    left = align_windows([x[0] for x in work], [x[1] for x in work], score)
    right = align_windows([x[2] for x in work], [x[3] for x in work], score)
    out = []
    for (l1, l2), (r1, r2), (a1, a2, b1, b2, c1, c2, p1, p2, n, w, size, turned) in zip(left, right, work):
        taken1, taken2 = (len(a1), len(a2)) if l1 else (0, 0)
        more1, more2 = (len(b1), len(b2)) if r1 else (0, 0)
        top, low = l1[::-1] + c1 + r1, l2[::-1] + c2 + r2
        marks = "".join(" " if "-" in (x, y) else "|" if x == y else "." for x, y in zip(top, low))
        begin1, end1 = p1 - taken1, p1 + n + more1
        # On the turned strand the seed itself isn't counted in the second range; that is how it is defined.
        begin2, end2 = (size - w - more2, size - w + taken2) if turned else (p2 - taken2, p2 + n + more2)
        hits = marks.count("|")
        out.append((begin1, begin2, end1, end2, end1 - begin1, end2 - begin2, top, low[::-1].translate(_TURN) if turned else low, len(top),
                    hits, marks.count("."), marks.count(" "), hits / len(top) if top else 0.0, marks))
    return pd.DataFrame(out, columns=[x.split()[0] for x in EXTENDED.split(", ")])


def extend_with_gaps(seeds: DataFrame, min_identity: float = 0.8, max_extension: int = 50, score: Scoring = Scoring()) -> DataFrame:
    """Seeds extended by up to ``max_extension`` letters on either side, with gaps; a narrow pass.

    Args:
        seeds: ``s1, s2, pos1, pos2, length, orientation`` and any other columns, which are kept; a column named
            ``gapped`` is replaced. Rows in which one of the six is null get a null.

    Returns:
        ``seeds`` with the struct ``gapped`` (the fields of EXTENDED), null where the identity is below
        ``min_identity``. seq2_aligned stands as in s2. For the reverse complement, length2 leaves out the seed.
    """

    def extend(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        names = ("s1", "s2", "pos1", "pos2", "length", "orientation")
        for batch in batches:
            rows = pd.DataFrame(dict(zip(names, batch)))
            good = rows.notna().all(axis=1)
            done = [extend_batch(rows[good].astype({"pos1": int, "pos2": int, "length": int}).iloc[k : k + TOGETHER], max_extension, score) for k in range(0, int(good.sum()), TOGETHER)]
            made = pd.concat(done, ignore_index=True) if done else extend_batch(rows.iloc[:0], max_extension, score)
            made.index = rows.index[good]
            yield made.reindex(rows.index).astype({c: "Int64" for c in made.columns if c not in ("seq1_aligned", "seq2_aligned", "identity", "alignment_string")})

    udf = F.pandas_udf(extend, EXTENDED)
    names = ("s1", "s2", "pos1", "pos2", "length", "orientation")
    made = seeds.withColumn("gapped", udf(*names))
    return made.withColumn("gapped", F.when(F.col("gapped.identity") >= min_identity, F.col("gapped")))
