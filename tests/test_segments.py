"""Search by segments and overlaps and greedy removal of near hits, beside plain models."""

import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seqloom.common import table
from seqloom.operators.elements import newest_elements
from seqloom.operators.search import deduplicate_hits
from seqloom.operators.segments import search_segments, search_words
from seqloom.queries.elements import QUERIES

SMALL = "/root/testdata/sf0.01"
TURN = str.maketrans("ACGT", "TGCA")


def model(query: str, target: str, word: int, identity: Fraction, coverage: Fraction, seeded: bool = True) -> set:
    """All diagonals with a shared word (or all), and the best of all their segments."""
    found = set()
    for strand, q in ((1, query), (-1, query[::-1].translate(TURN))):
        for shift in range(-len(q) + 1, len(target)):
            b, e = max(-shift, 0), min(len(q), len(target) - shift)
            same = [q[i] == target[i + shift] and q[i] in "ACGT" for i in range(b, e)]
            if seeded and not any(all(same[i : i + word]) for i in range(len(same) - word + 1)):
                continue
            fine = []
            for i in range(len(same)):
                hits = 0
                for j in range(i, len(same)):
                    hits += same[j]
                    n = j + 1 - i
                    if n >= coverage * len(q) and hits >= identity * n:
                        fine.append((-(5 * hits - 3 * n), i, n, hits))
            if fine:
                _, i, n, hits = min(fine)
                found.add((strand, b + i + 1, b + i + n, b + i + shift + 1, b + i + shift + n, hits))
    return found


def texts(seed: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    queries = [draw(rng.randint(5, 60)) for _ in range(6)] + ["ACGTN" * 6, "A" * 30]
    targets = []
    for q in queries:
        part = [x if rng.random() < 0.9 else rng.choice("ACGTN") for x in q[len(q) // 4 :]]
        turned = "".join(part)[::-1].translate(TURN)
        targets += [draw(20) + "".join(part) + draw(15), draw(rng.randint(0, 30)) + turned]
    return queries, [*targets, targets[0], "N" * 40]


def test_segments_like_model(spark):
    queries, targets = texts(1)
    q = spark.createDataFrame([(f"q{n}", x.lower() if n % 2 else x) for n, x in enumerate(queries)] + [("none", None), (None, "ACGTACGT")], "query_id string, query string")
    t = spark.createDataFrame([(f"t{n}", x) for n, x in enumerate(targets)], "target_id string, sequence string")
    expected = {(f"q{n}", f"t{m}", *x) for n, a in enumerate(queries) for m, b in enumerate(targets) for x in model(a, b, 6, Fraction(4, 5), Fraction(3, 10))}
    assert len({x[2] for x in expected}) == 2
    for letters in (100, 10**6):
        rows = search_segments(q, t, 6, 0.8, 0.3, block_letters=letters).collect()
        assert {tuple(r)[:8] for r in rows} == expected and len(rows) == len(expected)
        assert all(r.identity == r.matches / (r.query_end - r.query_start + 1) for r in rows)
    assert search_segments(q, t.limit(0), 6).count() == 0


def overlaps(query: str, target: str, word: int, identity: float, coverage: float) -> set:
    """All diagonals with a shared word whose whole overlap meets the limits."""
    found = set()
    for strand, q in ((1, query), (-1, query[::-1].translate(TURN))):
        for shift in range(-len(q) + 1, len(target)):
            b, e = max(-shift, 0), min(len(q), len(target) - shift)
            same = [q[i] == target[i + shift] and q[i] in "ACGT" for i in range(b, e)]
            seeded = any(all(same[i : i + word]) for i in range(len(same) - word + 1))
            if seeded and sum(same) / (e - b) >= identity and (e - b) / len(q) >= coverage:
                found.add((strand, b + 1, e, b + shift + 1, e + shift, sum(same)))
    return found


def test_overlaps_like_model(spark):
    queries, targets = texts(2)
    q = spark.createDataFrame([(f"q{n}", x) for n, x in enumerate([*queries, queries[0]])] + [("none", None), ("empty", ""), (None, "ACGTACGT")], "query_id string, query string")
    t = spark.createDataFrame([(f"t{n}", x.lower()) for n, x in enumerate(targets)] * 2, "target_id string, sequence string")
    expected = {(f"q{n}", f"t{m}", *x) for n, a in enumerate([*queries, queries[0]]) for m, b in enumerate(targets) for x in overlaps(a, b, 6, 0.8, 0.3)}
    assert len({x[2] for x in expected}) == 2
    for letters in (100, 10**6):
        rows = search_words(q, t, 6, 0.8, 0.3, block_letters=letters).collect()
        assert {tuple(r)[:8] for r in rows} == expected and len(rows) == len(expected)
    assert search_words(q.limit(0), t, 6).count() == 0


@pytest.mark.parametrize("at_once, rows_per_task", [(500, 100_000), (9, 20)])
def test_near_hits_in_rounds(spark, at_once, rows_per_task):
    """Large queries, settled in rounds, keep what one pass keeps; scores tie, are null or no number, and ids are large."""
    rng = random.Random(11)
    rows = []
    for query, many in (("big", 60), (None, 25), ("small", 3), ("blank", 12)):
        bases = ["".join(rng.choices("ACGT", k=rng.randint(10, 40))) for _ in range(4)]
        for n in range(many):
            text = "".join(x if rng.random() < 0.9 else rng.choice("ACGTNé") for x in rng.choice(bases))[: rng.randint(8, 40)]
            text = "" if query == "blank" or n % 9 == 8 else text.lower() if n % 4 == 3 else text
            rows.append((query, None if n == 5 else 2**60 + n, rng.choice([1.0, 2.0, 3.0, None, float("nan")]), text or None, "other"))
    rows += rows[:10]

    def behind(r):  # as Spark orders: null first, NaN last
        score = (0, 0) if r[2] is None else (2, 0) if r[2] != r[2] else (1, -r[2])
        return score, (r[1] is not None, r[1] or 0), r[3] or ""

    def near(a, b):
        a, b = a.upper(), b.upper()
        return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) >= 0.8

    expected = []
    for query in {r[0] for r in rows}:
        own = sorted({(r[0], r[1], str(r[2]), r[3]): r for r in rows if r[0] == query}.values(), key=behind)
        kept = []
        for r in own:
            if r[3] and not any(near(r[3], x[3]) for x in kept):
                kept.append(r)
        expected += kept or own
    hits = spark.createDataFrame(rows, "query_id string, hit_id bigint, bit_score double, sequence string, `place` string")
    found = deduplicate_hits(hits, 0.8, at_once, rows_per_task).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], r[1], r[2], r[3])) for r in expected)
    assert deduplicate_hits(hits.limit(0), 0.8, at_once, rows_per_task).count() == 0


def test_interior_match(spark):
    """30 equal letters within an overlap of 60 whose other letters differ."""
    rng = random.Random(5)
    core = "".join(rng.choices("ACGT", k=30))
    q = spark.createDataFrame([("q", "A" * 15 + core + "A" * 15)], "query_id string, query string")
    t = spark.createDataFrame([("t", "G" * 15 + core + "G" * 15)], "target_id string, sequence string")
    assert search_words(q, t).count() == 0
    assert [tuple(r) for r in search_segments(q, t).collect()] == [("q", "t", 1, 16, 45, 16, 45, 30, 1.0, 0.5)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_whole_flanks(spark):
    """Every flank and region that share 30 letters are met, wherever in the flank; both sides are searched."""
    rows = newest_elements(table(spark, SMALL, "is_elements")).select(
        "is_id", F.col("flanking_upstream.sequence").alias("upstream"), F.col("flanking_downstream.sequence").alias("downstream"), F.col("orf_annotation.noncoding_regions").alias("regions")
    ).collect()
    regions = {f"{r.is_id}:{n}": x.sequence.upper() for r in rows for n, x in enumerate(r.regions or []) if x and x.sequence}
    shared = set()
    for r in rows:
        for side in ("upstream", "downstream"):
            flank = (r[side] or "").upper()
            parts = {flank[i : i + 30] for i in range(len(flank) - 29)}
            parts = {p for p in parts if not set(p) - set("ACGT")}
            shared |= {(f"{r.is_id}:{side}", t) for t, u in regions.items() if any(p in u for p in parts)}
    found = {(r.query_id, r.target_id) for r in QUERIES["flank_segments"](spark, SMALL).collect()}
    assert {q.rpartition(":")[2] for q, _ in found} == {"upstream", "downstream"} and shared and shared <= found
