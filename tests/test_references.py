"""Orphan references against a plain look at every parent row."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqloom.operators.references import orphan_references, orphans_by_period

DAY = datetime(2030, 1, 1)
REFS = "ref_table string, ref_id bigint, key string, at timestamp, salt string, t int"
PARENTS = "key string, valid_from timestamp, valid_to timestamp, salts int, row string"


def plain(refs, parents):
    out = set()
    for table, i, key, at, *_ in refs:
        if key is None:
            continue
        own = [(f, t) for k, f, t, *_ in parents if k == key and f is not None]
        begun = [(f, t) for f, t in own if at is not None and f <= at]
        if any(t is None or t > at for f, t in begun):
            continue
        reason = "missing" if not own else "undated" if at is None else "deleted" if begun else "late"
        out.add((table, i, key, at, reason))
    return out


@pytest.mark.parametrize("per_task", [10, 10**6])
def test_against_plain(spark, per_task):
    draw = random.Random(2)
    day = lambda: DAY + timedelta(days=draw.randrange(60))
    parents = []
    for k in range(20):
        for _ in range(draw.randrange(0, 3)):
            f = day()
            parents.append((f"k{k}", f, draw.choice([None, f + timedelta(days=5), f + timedelta(days=draw.randrange(0, 20))]), 1, "x"))
    parents += parents[:5] + [(None, day(), None, 1, "x"), ("k1", None, None, 1, "x"), ("onlynull", None, None, 1, "x")]
    refs = [("a", i, draw.choice(["k0", "k3", f"k{draw.randrange(25)}", "onlynull", None]), draw.choice([day(), day(), None]), "s", 0) for i in range(400)]
    refs += [("b", 1, "k2", day(), "s", 0)] + refs[:30]
    found = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), per_task)
    rows = [tuple(r) for r in found.select("ref_table", "ref_id", "key", "at", "reason").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(refs, parents)
    assert {"missing", "late", "deleted", "undated"} == {r[4] for r in rows}
    counts = orphans_by_period(found).agg(F.sum("n_orphans")).first()[0]
    assert counts == len(rows)


def test_no_parents_and_no_references(spark):
    refs = spark.createDataFrame([("a", 1, "k", DAY, "", 0)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert [r.reason for r in orphan_references(refs, none).collect()] == ["missing"]
    assert orphan_references(refs.limit(0), none).count() == 0


def test_limits_of_validity(spark):
    parents = spark.createDataFrame([("k", DAY, DAY + timedelta(days=1), 0, "")], PARENTS)
    times = [DAY - timedelta(seconds=1), DAY, DAY + timedelta(hours=23), DAY + timedelta(days=1)]
    refs = spark.createDataFrame([("a", i, "k", t, "", 0) for i, t in enumerate(times)], REFS)
    assert {r.ref_id: r.reason for r in orphan_references(refs, parents).collect()} == {0: "late", 3: "deleted"}
