"""Alignments against a plain model that follows the rules position by position."""

import random

import pytest

from seqloom.operators import alignments as A
from seqloom.operators.alignments import Finder, find_between, find_within
from seqloom.operators.gapped import Scoring, align_windows, extend_with_gaps

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(TURN)


def away(a, b):
    return sum(x != y for x, y in zip(a, b))


def model(s1, s2, w, k, least=None):
    found = []
    look = (lambda x: x, turned)
    for i in range(len(s1) - w + 1):
        for o in (0, 1):
            for j in range(len(s2) - w + 1):
                if least is not None and j - i < least:
                    continue
                if away(s1[i : i + w], look[o](s2[j : j + w])) > k:
                    continue
                p, q, n = i, j, w
                while p + n < len(s1) and q + n < len(s2) and away(s1[p : p + n + 1], look[o](s2[q : q + n + 1])) <= k:
                    n += 1
                while p and q and away(s1[p - 1 : p + n], look[o](s2[q - 1 : q + n])) <= k:
                    p, q, n = p - 1, q - 1, n + 1
                found.append((p, q, n, o, away(s1[p : p + n], look[o](s2[q : q + n]))))
    kept = []
    for x in sorted(found, key=lambda x: (-x[2], x[4])):
        if not any(x[3] == y[3] and x[0] < y[0] + y[2] and y[0] < x[0] + x[2] and x[1] < y[1] + y[2] and y[1] < x[1] + x[2] for y in kept):
            kept.append(x)
    return {(p, q, n, ("forward", "reverse_complement")[o], m) for p, q, n, o, m in kept}


def pairs(seed, n):
    draw = random.Random(seed)
    dna = lambda m: "".join(draw.choice("ACGT") for _ in range(m))
    out = []
    for k in range(n):
        core = dna(14)
        out.append((k, dna(20) + core + dna(15), dna(10) + draw.choice([core, turned(core), core[:6] + "T" + core[7:]]) + dna(25), 1))
    return out + [(n, None, "ACGT", 1), (n + 1, "ACG", "ACGTACGTAC", 1), (n + 2, "", "", 1), (None, "ACGTACGTAC", "ACGTACGTAC", 1)]


def test_small_portions_and_long_words_change_nothing(spark, monkeypatch):
    """Portions of a few pairs and candidates; words of more letters than a number holds; other letters than bases."""
    rows = [(n, (s1 or "") * 2 + "é-N", (s2 or "") * 2 + "é-N", 1) for n, s1, s2, _ in pairs(5, 6)]
    for finder in (Finder(6), Finder(13, 1), Finder(25), Finder(30, 1)):
        texts = [r[1] for r in rows], [r[2] for r in rows]
        whole = [x.tolist() for x in A._matches(*texts, finder, False)]
        monkeypatch.setattr(A, "TOGETHER", 5)
        alone = [[x.tolist() for x in A._matches([a], [b], finder, False)[1:]] for a, b in zip(*texts)]
        monkeypatch.undo()
        assert [sum((one[c] for one in alone), []) for c in range(5)] == whole[1:]
        for n, (a, b) in enumerate(zip(*texts)):
            own = {(p, q, m, A.ORIENTATIONS[o], k) for row, o, p, q, m, k in zip(*whole) if row == n}
            assert own == model(a, b, finder.min_length, finder.max_mismatches)


@pytest.mark.parametrize("w,k", [(6, 0), (8, 1), (7, 2)])
def test_between(spark, w, k):
    rows = pairs(w, 12)
    df = spark.createDataFrame(rows, "pair_id int, s1 string, s2 string, i int")
    found = find_between(df, Finder(min_length=w, max_mismatches=k)).collect()
    for n, s1, s2, _ in rows:
        if n is not None:
            own = {(r.pos1, r.pos2, r.length, r.orientation, r.mismatches) for r in found if r.pair_id == n}
            assert own == (model(s1, s2, w, k) if s1 else set())
    for r in found:
        assert len(r.mismatch_positions) == r.mismatches


def test_within(spark):
    draw = random.Random(9)
    rows = [(n, "".join(draw.choice("ACGT") for _ in range(70)).lower()) for n in range(10)]
    found = find_within(spark.createDataFrame(rows, "pair_id int, seq string"), Finder(min_length=6)).collect()
    for n, s in rows:
        own = {(r.pos1, r.pos2, r.length, r.orientation, r.mismatches) for r in found if r.pair_id == n}
        assert own == model(s.upper(), s.upper(), 6, 0, least=6)
    near = find_within(spark.createDataFrame(rows, "pair_id int, seq string"), Finder(min_length=6, min_distance=10, max_distance=20)).collect()
    assert all(10 <= r.distance <= 20 for r in near)


def test_wrong_settings():
    for bad in ({"min_length": 0}, {"max_mismatches": -1}, {"min_length": 3, "max_mismatches": 3}, {"min_distance": 5, "max_distance": 4}, {"check_forward": False, "check_revcomp": False}):
        with pytest.raises(ValueError):
            Finder(**bad)


def plain_score(a, b, top, low, s=Scoring()):
    """Score of an alignment whose near end is free: gaps that begin it cost as any other, pairs begin at 0."""
    total, last = 0, None
    for x, y in zip(top, low):
        kind = 1 if y == "-" else 2 if x == "-" else 0
        if kind == 0:
            total += s.match if x == y else s.mismatch
        else:
            total += s.gap_extend + (s.gap_open if kind != last else 0)
        last = kind
    return total


def test_windows_are_consumed_and_gaps_are_affine():
    draw = random.Random(3)
    first, second = [], []
    for _ in range(60):
        a = "".join(draw.choice("ACGT") for _ in range(draw.randrange(0, 20)))
        cut = draw.randrange(0, len(a) + 1)
        first.append(a)
        second.append(a[:cut] + a[min(len(a), cut + draw.randrange(0, 4)) :] if draw.random() < 0.7 else "".join(draw.choice("ACGT") for _ in range(9)))
    for a, b, (top, low) in zip(first, second, align_windows(first, second)):
        if a and b:
            assert top.replace("-", "") == a and low.replace("-", "") == b and len(top) == len(low)
            assert not any(x == y == "-" for x, y in zip(top, low))
        else:
            assert (top, low) == ("", "")
    assert align_windows(["ACGTACGT"], ["ACGTACGT"]) == [("ACGTACGT", "ACGTACGT")]
    alone = [align_windows([a], [b])[0] for a, b in zip(first, second)]
    assert alone == align_windows(first, second)  # padding changes nothing


def test_extension_over_a_gap(spark):
    s1 = "TTGACCTAGGCATTCGATTACGGATCCA"
    s2 = s1[:14] + "GGG" + s1[14:]
    rows = [(1, s1, s2, 0, 0, 14, "forward", "kept"), (2, s1, turned(s2), 0, len(s2) - 14, 14, "reverse_complement", "x"), (3, s1, "A" * 40, 0, 0, 14, "forward", "y"), (4, None, s2, 0, 0, 14, "forward", "z")]
    df = spark.createDataFrame(rows, "pair_id int, s1 string, s2 string, pos1 int, pos2 int, length int, orientation string, gapped string")
    out = {r.pair_id: r.gapped for r in extend_with_gaps(df).collect()}
    assert (out[1].gaps, out[1].matches, out[1].mismatches, out[1].end1, out[1].end2) == (3, 28, 0, 28, 31)
    assert out[1].alignment_length == out[1].matches + out[1].mismatches + out[1].gaps
    assert (out[2].gaps, out[2].matches) == (3, 28)
    assert out[3] is None and out[4] is None


# Known inputs and their published or independently worked out results.
WITHIN = [
    ("ACGTACGTACNNNNACGTACGTAC", Finder(9), [(0, 14, 10, "f", 0)]),
    ("acgtacgtacnnnnacgtacgtac", Finder(9), [(0, 14, 10, "f", 0)]),
    ("ACGTACGTACGTNNNNACGTACGTACGT", Finder(9, check_revcomp=False), [(0, 16, 12, "f", 0)]),
    ("ACGTACGTACNNNNACGTGCGTAC", Finder(8, 1), [(0, 14, 8, "r", 1), (0, 14, 10, "f", 1)]),
    ("ACGTACGTACNNNNACGTGCGTAC", Finder(9, 1), [(0, 14, 10, "f", 1)]),
    ("ACGTACGTACNNNNACATACATAC", Finder(9, 2), [(0, 14, 10, "f", 2)]),
    ("ACGT", Finder(9), []),
]
BETWEEN = [
    ("ATGCATGCACGTACGTACNNNN", "NNNNACGTACGTACGCTAGCTA", [(8, 4, 10, "f", 0), (9, 6, 9, "r", 0)]),
    ("ACGT" * 4, "NNNNN" + "ACGT" * 4 + "NNNNN", [(0, 5, 16, "f", 0), (0, 8, 9, "r", 0)]),
    ("GCTAGCTAGCTAGCTA", "AAAAGCTAGCTAGCTAGCTAAAAA", [(0, 4, 16, "f", 0), (0, 5, 9, "r", 0)]),
]
SPACERS = [
    ("AAACGAACCACCUUCAUUCGAGUACAAGAGCA", "AAGCGTACAACGTTTATCCGAGTTCAAGAGCA", (25, 7, 0, 32)),
    ("AAAUUUACAUCUCCAGGCUCAGCCAAAAAGC", "AAATTAACGTCGCCAGGTTCAGCTAAAAAAC", (25, 6, 0, 31)),
    ("AGGACAGGAAGAAAACACCCAAGUUGGG", "AGGACCGGAAGGTAGCAGCCAAGGCGGG", (21, 7, 0, 28)),
    ("AAAAACAAUCGAUUCGAUGUUUAAGUUAA", "AAAAAGAACCGTTTTGATGTCTATGTAAA", (22, 7, 0, 29)),
]


def short(rows):
    return sorted((r.pos1, r.pos2, r.length, r.orientation[0], r.mismatches) for r in rows)


def test_known_alignments(spark):
    for seq, finder, expected in WITHIN:
        found = find_within(spark.createDataFrame([(1, seq)], "pair_id int, seq string"), finder).collect()
        assert short(found) == expected
    for s1, s2, expected in BETWEEN:
        found = find_between(spark.createDataFrame([(1, s1, s2)], "pair_id int, s1 string, s2 string"), Finder(9)).collect()
        assert set(expected) <= set(short(found))


def test_known_gapped_alignments(spark):
    from pyspark.sql import functions as F

    from seqloom.functions.sequence import to_dna
    from seqloom.operators.analytics import best_per_group

    rows = [(i, a, b) for i, (a, b, _) in enumerate(SPACERS)]
    pairs_ = spark.createDataFrame(rows, "pair_id int, s1 string, s2 string").withColumns({"s1": to_dna("s1"), "s2": to_dna("s2")})
    seeds = best_per_group(find_between(pairs_, Finder(8, 2)), ["pair_id"], [F.col("pos1"), F.col("pos2"), F.desc("length")], 3)
    made = extend_with_gaps(seeds.join(pairs_, "pair_id"), 0.7, 40).where("gapped is not null")
    best = best_per_group(made.drop("rank"), ["pair_id"], [F.desc("gapped.identity"), F.col("pos1")], 1)
    found = {r.pair_id: (r.gapped.matches, r.gapped.mismatches, r.gapped.gaps, r.gapped.alignment_length) for r in best.collect()}
    assert found == {i: x for i, (_, _, x) in enumerate(SPACERS)}
    one = spark.createDataFrame([("ACGT" * 4, "ACGTACGTNNNACGTACGT", 0, 0, 8, "forward")], "s1 string, s2 string, pos1 int, pos2 int, length int, orientation string")
    g = extend_with_gaps(one, 0.75).first().gapped
    assert (g.matches, g.mismatches, g.gaps, g.alignment_length, round(g.identity, 3)) == (16, 0, 3, 19, 0.842)
    assert (g.seq1_aligned, g.seq2_aligned) == ("ACGTACGT---ACGTACGT", "ACGTACGTNNNACGTACGT")
