"""Merging of intervals against a plain sweep, with huge entities cut into shards."""

import random

import pytest

from seqloom.operators import intervals as I

SCHEMA = "who string, other int, a bigint, b bigint, s bigint, e bigint, shard string, cuts int"


def sweep(rows):
    by = {}
    for who, other, a, b, *_ in rows:
        if who is not None and other is not None and a is not None and b is not None and a <= b:
            by.setdefault((who, other), []).append((a, b))
    out = set()
    for key, own in by.items():
        merged = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


def rows_of(seed, dense):
    draw = random.Random(seed)
    rows = []
    for who in ("hot", "cold", "tiny", "ties"):
        for _ in range({"hot": 600, "cold": 60, "tiny": 1, "ties": 200}[who]):
            a = draw.randrange(-50, 200 if who == "ties" else 4000 * (1 if dense else 5))
            n = draw.choice([0, 1, 3, 8] if draw.random() < 0.97 else [900, 2500])
            rows.append((who, 1, a, a + n, 0, 0, "x", 7))
    rows += rows[:40]
    return rows + [("bad", 1, 5, 4, 0, 0, "", 0), (None, 1, 1, 2, 0, 0, "", 0), ("hot", None, 1, 2, 0, 0, "", 0), ("n", 1, None, 2, 0, 0, "", 0), ("n", 1, 2, None, 0, 0, "", 0), ("big", 1, 1, 2**63 - 1, 0, 0, "", 0)]


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("per_shard", [20, 150, 10**6])
def test_against_sweep(spark, dense, per_shard):
    rows = rows_of(per_shard, dense)
    found = I.merge_intervals(spark.createDataFrame(rows, SCHEMA).repartition(3), ["who", "other"], "a", "b", per_shard).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == sweep(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert I.merge_intervals(df, ["who"], "a", "b", 5).count() == 0
