"""Nested records to flat tables by columnar shredding.

Every leaf of the schema becomes one column of entries ``(r, d, v)``: the repetition level (at which repeated
ancestor the entry continues; 0 begins a record), the definition level (how many of the optional or repeated
ancestors, and the leaf itself, are there) and the value. A null or empty part still leaves one entry, so nothing
is lost. The table of any object is rebuilt from the entries of its own leaves alone: the definition level says
whether the object is there, and the repetition levels count its place in the arrays around it.

Levels follow the three-level list layout: an optional object or leaf adds one to the definition level; an array
adds one for being there, one for having a slot, and its element one for not being null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Leaf:
    """A leaf path with its highest levels; ``owner`` is the path of the object that holds it."""

    path: tuple[str, ...]
    max_repetition: int
    max_definition: int
    kind: T.DataType
    owner: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.path)


@dataclass(frozen=True)
class Node:
    """An object of the schema: its path, the levels at which it is there, its own leaves, and the leaf that shows whether it is
    there: one of its own, the slimmest, or of an object in it."""

    path: tuple[str, ...]
    repetition: int
    definition: int
    leaves: tuple[Leaf, ...]
    witness: Leaf | None = None

    @property
    def name(self) -> str:
        return ".".join(self.path)


def nodes(schema: T.StructType) -> list[Node]:
    """All objects below the record, outer ones first; an array of plain values is an object with one leaf."""
    found: list[Node] = []

    def visit(kind: T.StructType, path: tuple[str, ...], r: int, d: int) -> None:
        leaves = []
        inner = []
        for f in kind.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                inner.append((f.dataType, at))
            else:
                leaves.append(Leaf(at, r, d + 1, f.dataType, path))
        if path:
            found.append(Node(path, r, d, tuple(leaves)))
        for sub, at in inner:
            sr, sd = r, d + 1
            while isinstance(sub, T.ArrayType):
                sr, sd, sub = sr + 1, sd + 2, sub.elementType
            if isinstance(sub, T.StructType):
                visit(sub, at, sr, sd)
            else:
                found.append(Node(at, sr, sd, (Leaf(at, sr, sd, sub, at),)))

    visit(schema, (), 0, 0)
    slim = lambda leaf: isinstance(leaf.kind, T.StringType)
    below = {n.path: n.leaves or [x for m in found if m.path[: len(n.path)] == n.path for x in m.leaves] for n in found}
    return [replace(n, witness=min(below[n.path], key=slim)) for n in found if below[n.path]]


def shred_column(schema: T.StructType, leaf: Leaf, values: bool = True) -> Column:
    """The leaf's entries, an array of structs (r, d, v), from the record's top-level columns.

    ``values=False`` leaves v null, where only levels are wanted.
    """
    keep = leaf.kind if values else T.BooleanType()

    def entry(r: Column, d: int, v: Column | None = None) -> Column:
        v = F.lit(None).cast(keep) if v is None or not values else v
        return F.array(F.struct(r.cast("int").alias("r"), F.lit(d).alias("d"), v.alias("v")))

    def walk(value: Column, kind: T.DataType, rest: tuple[str, ...], r: Column, depth: int, d: int) -> Column:
        if isinstance(kind, T.ArrayType):
            slots = F.transform(
                value,
                lambda x, i: walk(x, kind.elementType, rest, F.when(i == 0, r).otherwise(F.lit(depth + 1)), depth + 1, d + 2),
            )
            return F.when(value.isNull(), entry(r, d)).when(F.size(value) == 0, entry(r, d + 1)).otherwise(F.flatten(slots))
        if isinstance(kind, T.StructType) and rest:
            below = walk(value.getField(rest[0]), kind[rest[0]].dataType, rest[1:], r, depth, d + 1)
            return F.when(value.isNull(), entry(r, d)).otherwise(below)
        return F.when(value.isNull(), entry(r, d)).otherwise(entry(r, d + 1, value))

    head = leaf.path[0]
    return walk(F.col(f"`{head}`"), schema[head].dataType, leaf.path[1:], F.lit(0), 0, 0)


def places(node: Node, entries: Column) -> Column:
    """For each entry the places (from 0) in the arrays around it, outermost first, from the repetition levels.

    An object outside any array has the one place 0. In one array the place is the number of entries that have continued it,
    level 1, since level 0 began the record: the distance from the entry of level 0.
    """
    if node.repetition == 0:
        return F.transform(entries, lambda x: F.array(F.lit(0)))
    if node.repetition == 1:
        begun = F.array_position(F.transform(entries, lambda x: x["r"]), 0).cast("int") - 1
        return F.transform(entries, lambda x, i: F.array(i - begun))
    deep = node.repetition
    zero = F.array(*[F.lit(0)] * deep)

    def step(last: Column, r: Column) -> Column:
        return F.transform(
            last,
            lambda n, level: F.when(r == 0, 0).when(level + 1 < r, n).when(level + 1 == r, n + 1).otherwise(0),
        )

    empty = F.array().cast("array<array<int>>")
    return F.aggregate(
        entries,
        empty,
        lambda done, x: F.array_append(done, step(F.coalesce(F.try_element_at(done, F.lit(-1)), zero), x["r"])),
    )


def _begun(node: Node, entries: Column) -> Column:
    """Of the witness's entries those that begin an object of the node: deeper repetitions go on within one."""
    return entries if node.witness.max_repetition == node.repetition else F.filter(entries, lambda x: x["r"] <= node.repetition)


def child_places(schema: T.StructType, wanted: dict[str, str]) -> Column:
    """One array of (child_kind, child_no) for the objects in ``wanted`` (path to kind) that are there.

    Built from the level entries of one leaf of each object; the innermost place is the child's number.
    """

    def children(node: Node) -> Column:
        entries = _begun(node, shred_column(schema, node.witness, values=False))
        child = lambda e, p: F.when(
            e["d"] >= node.definition,
            F.struct(F.lit(wanted[node.name]).alias("child_kind"), F.element_at(p, -1).alias("child_no")),
        )
        return F.array_compact(F.zip_with(entries, places(node, entries), child))

    return F.concat(*[children(node) for node in nodes(schema) if node.name in wanted])


def node_rows(schema: T.StructType, node: Node) -> Column:
    """One array of (places, child_no, leaves) for the objects of a node that are there, from the level entries of its leaves."""
    first = _begun(node, shred_column(schema, node.witness, values=False))
    streams = {f"l{i}": shred_column(schema, leaf) for i, leaf in enumerate(node.leaves)}
    zipped = F.arrays_zip(first.alias("e"), places(node, first).alias("p"), *[c.alias(n) for n, c in streams.items()])
    there = F.filter(zipped, lambda z: z["e"]["d"] >= node.definition)
    leaves = lambda z: [z[f"l{i}"]["v"].alias(leaf.path[-1]) for i, leaf in enumerate(node.leaves)]
    return F.transform(there, lambda z: F.struct(z["p"].alias("places"), F.element_at(z["p"], -1).alias("child_no"), *leaves(z)))


def shred_tables(df: DataFrame, key: str, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables, one for each object in the nested columns of ``df``.

    Each table has ``record_key`` (the value of ``key``), ``places`` (array of the places in the arrays around the
    object, outermost first), ``child_no`` (the last of these) and a column for each leaf of the object. Objects
    that are null give no row, but still count in the places of an array; a record without any such object gives
    none. All of it is one narrow pass over the records, without a shuffle. Rows with the same key are shredded
    independently; use ``latest_version`` first where only one is wanted.
    """
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
    schema = T.StructType([df.schema[c] for c in columns])
    tables = {}
    for node in nodes(schema):
        rows = df.select(F.col(f"`{key}`").alias("record_key"), F.explode(node_rows(schema, node)).alias("x"))
        tables[node.name] = rows.select("record_key", "x.*")
    return tables
