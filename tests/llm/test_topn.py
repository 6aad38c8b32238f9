"""The N best rows per group against a plain sort, with a heavy group, ties, copies and nulls."""

import math
import random

import pytest

from seqloom.llm.topn import top_n_per_group

SCHEMA = "q string, hit_id bigint, bitscore double, evalue double, g string, k0 int, rank string"


def plain(rows, n):
    by = {}
    for q, hit, score, evalue, *_ in rows:
        if q is not None and hit is not None:
            key = (score is None, -score if score is not None else 0.0, evalue is None, evalue if evalue is not None else 0.0, hit)
            own = by.setdefault(q, {})
            own[hit] = min(own.get(hit, key), key)
    return {(q, hit) for q, own in by.items() for hit in sorted(own, key=own.get)[:n]}


@pytest.mark.parametrize("chunk", [7, 100, 1 << 18])
def test_against_plain_sort(spark, chunk):
    draw = random.Random(1)
    rows = []
    for i in range(3000):
        q = "hot" if draw.random() < 0.35 else None if draw.random() < 0.02 else f"q{draw.randrange(200)}"
        score = draw.choice([None, 1.0, 2.0, 2.0, 3.5, 0.0, -0.0])
        row = (q, i, score, draw.choice([None, 0.0, 1e-9]), "x", 1, "y")
        rows += [row] * draw.choice([1, 1, 1, 4])
    found = top_n_per_group(spark.createDataFrame(rows, SCHEMA).repartition(5), "q", "hit_id", [("bitscore", "desc"), ("evalue", "asc")], 5, chunk=chunk)
    assert {(r.group_key, r.item_id) for r in found.collect()} == plain(rows, 5)
    ranks = [(r.group_key, r["rank"]) for r in found.collect()]
    assert len(ranks) == len(set(ranks))


def test_copies_of_one_item_set_no_bound(spark):
    rows = [("a", 1, 9.0, 0.0, "", 0, "")] * 50 + [("a", i, float(-i), 0.0, "", 0, "") for i in range(2, 9)]
    found = top_n_per_group(spark.createDataFrame(rows, SCHEMA).coalesce(1), "q", "hit_id", [("bitscore", "desc")], 5)
    assert sorted(r.item_id for r in found.collect()) == [1, 2, 3, 4, 5]


def test_item_with_differing_scores_counts_with_its_best(spark):
    rows = [("a", 1, 1.0, 0.0, "", 0, ""), ("a", 1, 7.0, 0.0, "", 0, ""), ("a", 2, 5.0, 0.0, "", 0, "")]
    found = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "q", "hit_id", [("bitscore", "desc")], 1).collect()
    assert [(r.item_id, r["rank"]) for r in found] == [(1, 1)]


def test_nan_comes_behind_numbers_and_empty_is_empty(spark):
    rows = [("a", 1, math.nan, 0.0, "", 0, ""), ("a", 2, 5.0, 0.0, "", 0, ""), ("a", 3, None, 0.0, "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    up = top_n_per_group(df, "q", "hit_id", [("bitscore", "asc")], 3).orderBy("rank").collect()
    assert [r.item_id for r in up] == [2, 1, 3]
    assert top_n_per_group(df.limit(0), "q", "hit_id", [("bitscore", "asc")], 3).count() == 0
