"""Shared spans against the comparison of all windows."""

import random

import numpy as np
import pytest

from seqloom.llm import spans as S


def brute(rows, length):
    seen = {}
    for i, part, no, text in rows:
        if i is None or text is None:
            continue
        text = text.upper()
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            if set(w) <= set("ACGT"):
                seen.setdefault(w, set()).add(i)
    out = set()
    for i, part, no, text in rows:
        if i is None or text is None:
            continue
        t, hit = text.upper(), set()
        for p in range(len(t) - length + 1):
            if len(seen.get(t[p : p + length], ())) > 1:
                hit |= set(range(p, p + length))
        run = sorted(hit)
        while run:
            k = 0
            while k + 1 < len(run) and run[k + 1] == run[k] + 1:
                k += 1
            out.add((i, part, no, run[0], run[k] + 1))
            run = run[k + 1 :]
    return out


def dna(draw, n):
    return "".join(draw.choice("ACGT") for _ in range(n))


def sample(seed):
    draw = random.Random(seed)
    common = [dna(draw, 200) for _ in range(3)]
    rows = []
    for i in range(60):
        for no in range(draw.randrange(1, 4)):
            text = dna(draw, draw.randrange(0, 150))
            for _ in range(draw.randrange(0, 3)):
                c = draw.choice(common)
                a = draw.randrange(0, 150)
                text += c[a : a + draw.choice([39, 40, 41, 60, 90])] + dna(draw, draw.randrange(0, 30))
            if draw.random() < 0.2:
                text = text.lower()
            if text and draw.random() < 0.2:
                p = draw.randrange(len(text))
                text = text[:p] + draw.choice(["N", "-", "é", "漢"]) + text[p + 1 :]
            rows.append((f"r{i}", "up", no, text))
    alone = dna(draw, 60)
    rows += [("self", "up", 0, alone), ("self", "nc", 1, alone), (None, "up", 0, common[0]), ("nul", "up", 0, None), ("empty", "up", 0, "")]
    rows += [rows[0], rows[1]]
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id string, part string, no int, letters string")
    return df.withColumn("pos", F.lit("clash")).withColumn("hi", F.lit(1)).repartition(3)


@pytest.mark.parametrize("length,group_rows", [(40, S.GROUP_ROWS), (40, 1), (30, 5), (52, 5), (85, S.GROUP_ROWS)])
def test_against_all_windows(spark, length, group_rows):
    """Also with anchors of few surroundings split by their spans, and frequent surroundings spread."""
    rows = sample(1)
    found = {tuple(r) for r in S.shared_spans(frame(spark, rows), length, group_rows).collect()}
    assert found == brute(rows, length) and found


def test_frequent_codes_are_settled_beforehand(spark, monkeypatch):
    draw = random.Random(5)
    repeat = dna(draw, 120)
    rows = [(f"h{i}", "up", 0, dna(draw, 10) + repeat + dna(draw, 20)) for i in range(300)] + sample(3)
    windows = S.shared_spans(frame(spark, rows), 40)
    assert {tuple(r) for r in windows.collect()} == brute(rows, 40)
    clean = frame(spark, [r for r in rows if r[0] and r[3]]).selectExpr("id", "1L", "letters")
    codes = clean.mapInArrow(S._windows(20, np.zeros(0, np.int64)), S.FOUND)
    assert len(S._settled(codes)) > 0


def test_a_length_below_the_least_is_refused(spark):
    with pytest.raises(ValueError):
        S.shared_spans(frame(spark, [("a", "up", 0, "ACGT")]), 29)


def test_one_record_with_a_long_repeat_is_not_shared(spark):
    rows = [("a", "up", 0, "A" * 5000), ("b", "up", 0, "C" * 39), ("c", "up", 0, "C" * 39)]
    assert S.shared_spans(frame(spark, rows), 40).count() == 0
    assert S.shared_spans(frame(spark, rows).limit(0), 40).count() == 0


def test_difference_cover_reaches_every_pair():
    cover = set(S.COVER)
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in cover and (j + d) % S.PERIOD in cover for d in range(S.PERIOD))


@pytest.mark.parametrize("width", [1, 7, 19, 20, 31])
def test_window_codes(width):
    codes = np.random.default_rng(0).integers(0, 4, 100).astype(np.uint8)
    expected = [int("".join(map(str, codes[p : p + width])), 4) for p in range(100 - width + 1)]
    assert S.window_codes(codes, width).tolist() == expected
    assert S.window_codes(codes[: width - 1], width).size == 0


def test_shares(spark):
    rows = frame(spark, [("a", "up", 0, "ACGT" * 20), ("b", "up", 0, "ACGT" * 10 + "T" * 40), ("c", "up", 0, None)])
    shares = {r.id: (r.n_letters, r.n_shared) for r in S.shared_shares(rows, S.shared_spans(rows, 40)).collect()}
    assert shares == {"a": (80, 80), "b": (80, 40), "c": (0, 0)}
