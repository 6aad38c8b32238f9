"""Shredding: levels of the known textbook record, and flat tables of nested arrays."""

from pyspark.sql import Row

from seqloom.common import latest_version
from seqloom.operators import shredding as X
from pyspark.sql import functions as F

SCHEMA = """id string, places int, rec struct<
  links: struct<backward: array<bigint>, forward: array<bigint>>,
  name: array<struct<url: string, language: array<struct<code: string, country: string>>>>,
  plain: int>"""
ROWS = [
    ("r1", 1, ((None, [20, 40, 60]), [("http://A", [("en-us", "us"), ("en", None)]), ("http://B", None), (None, [("en-gb", "gb")])], 5)),
    ("r2", 1, (([10, 30], [80]), [("http://C", None)], None)),
    ("r3", 1, None),
    ("r4", 1, (None, [], 0)),
    ("r5", 1, (([], [None, 7]), [None, ("x", [None, ("c", "d")])], 1)),
]


def levels(spark, path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    schema = df.select("rec").schema
    leaf = next(l for n in X.nodes(schema) for l in n.leaves if l.name == path)
    return {r.id: [(e.r, e.d, e.v) for e in r.x] for r in df.select("id", X.shred_column(schema, leaf).alias("x")).collect()}


def test_levels(spark):
    code = levels(spark, "rec.name.language.code")
    # rec 1, name 2 (there), 3 (a slot), 4 (not null), language 5, 6, 7, code 8
    assert code["r1"] == [(0, 8, "en-us"), (2, 8, "en"), (1, 4, None), (1, 8, "en-gb")]
    assert code["r2"] == [(0, 4, None)]
    assert code["r3"] == [(0, 0, None)]
    assert code["r4"] == [(0, 2, None)]
    assert code["r5"] == [(0, 3, None), (1, 6, None), (2, 8, "c")]
    assert levels(spark, "rec.links.forward")["r1"] == [(0, 5, 20), (1, 5, 40), (1, 5, 60)]


def test_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    tables = {k: {tuple(r) for r in t.select("record_key", "places", *[c for c in t.columns if c not in ("record_key", "places", "child_no")]).rdd.map(lambda r: (r[0], tuple(r[1]), *r[2:])).collect()} for k, t in X.shred_tables(df, "id").items()}
    assert tables["rec"] == {("r1", (0,), 5), ("r2", (0,), None), ("r4", (0,), 0), ("r5", (0,), 1)}
    assert tables["rec.name"] == {("r1", (0,), "http://A"), ("r1", (1,), "http://B"), ("r1", (2,), None), ("r2", (0,), "http://C"), ("r5", (1,), "x")}
    assert tables["rec.name.language"] == {
        ("r1", (0, 0), "en-us", "us"), ("r1", (0, 1), "en", None), ("r1", (2, 0), "en-gb", "gb"), ("r5", (1, 1), "c", "d"),
    }
    assert tables["rec.links.forward"] == {("r1", (0,), 20), ("r1", (1,), 40), ("r1", (2,), 60), ("r2", (0,), 80), ("r5", (1,), 7)}
    assert tables["rec.links"] == {("r1", (0,)), ("r2", (0,)), ("r5", (0,))}  # has no leaf of its own


def test_child_places(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    made = X.child_places(df.select("rec").schema, {"rec": "rec", "rec.name": "name"})
    found = {r.id: [(c.child_kind, c.child_no) for c in r.x] for r in df.select("id", made.alias("x")).collect()}
    assert found["r1"] == [("rec", 0), ("name", 0), ("name", 1), ("name", 2)]
    assert found["r3"] == [] and found["r4"] == [("rec", 0)] and found["r5"] == [("rec", 0), ("name", 1)]


def test_empty_table(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).limit(0)
    assert all(t.count() == 0 for t in X.shred_tables(df, "id").values())


def test_latest_version(spark):
    rows = [Row(k="a", v=1, x="old"), Row(k="a", v=3, x="new"), Row(k="a", v=3, x="new"), Row(k="b", v=None, x="undated"), Row(k=None, v=9, x="none")]
    df = spark.createDataFrame(rows, "k string, v int, x string")
    found = latest_version(df, F.col("k"), F.col("v"), F.col("x")).collect()
    assert {(r.key, r.payload) for r in found} == {("a", "new"), ("b", "undated")}
    assert latest_version(df.limit(0), F.col("k"), F.col("v"), F.col("x")).count() == 0


def test_object_without_a_leaf_of_its_own(spark):
    """``outer`` holds only an array and an object; nothing of it is lost."""
    schema = "k int, outer struct<items: array<struct<parts: array<struct<v: int>>, note: struct<t: string>>>>"
    rows = [(1, {"items": [{"parts": [{"v": 1}, {"v": 2}], "note": None}, None, {"parts": [], "note": {"t": "x"}}]}), (2, {"items": None}), (3, None)]
    df = spark.createDataFrame(rows, schema)
    tables = X.shred_tables(df, "k")
    assert sorted((r.record_key, r.child_no) for r in tables["outer"].collect()) == [(1, 0), (2, 0)]
    assert sorted((r.record_key, r.child_no) for r in tables["outer.items"].collect()) == [(1, 0), (1, 2)]
    assert sorted((r.record_key, tuple(r.places), r.v) for r in tables["outer.items.parts"].collect()) == [(1, (0, 0), 1), (1, (0, 1), 2)]
    assert [(r.record_key, r.child_no, r.t) for r in tables["outer.items.note"].collect()] == [(1, 2, "x")]
