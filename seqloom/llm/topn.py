"""The N best rows of every group by partition lower bounds.

While a partition is read, the N-th best row of a group among some of its rows is a lower bound of the group's N-th
best row. The best of these bounds is joined to the rows of the groups that have most rows, and every group is bounded by
what stands in the same chunk of its partition; what lies behind a bound is dropped before any shuffle, and only the
survivors are ranked. A bound is the whole sort key, ties included, so a group of any size, and of any number of equal
scores, keeps at most N rows for each chunk that it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are looked at together for one set of bounds, in a task.
CHUNK = 1 << 20
#: The most bounds that are broadcast: those of the groups with most rows.
BROADCAST_BOUNDS = 50_000


def _keys(order: Sequence[tuple[str, str]], id_column: str) -> list[Column]:
    """Ascending sort keys: for each column whether it is null, and its value; at last the id."""
    keys = []
    for name, way in order:
        c = F.col(name).cast("double")
        keys += [F.col(name).isNull().cast("int"), F.coalesce((-c if way == "desc" else c) + F.lit(0.0), F.lit(0.0))]
    return [*keys, F.col(id_column).cast("bigint")]


def top_n_per_group(
    df: DataFrame, group: str | Column, id_column: str, order: Sequence[tuple[str, str]], n: int, chunk: int = CHUNK
) -> DataFrame:
    """The first ``n`` rows of every group, all of them if there are fewer.

    Args:
        df: columns that aren't named by the other arguments are ignored, whatever their names.
        group: the group's column or expression; rows with a null group take no part.
        id_column: whole number that names an item, and the last tie rule. Rows of a group with the same id are one
            item; should their scores differ, its best row counts. Rows with a null id take no part.
        order: (numeric column, 'asc' or 'desc') in turn. NaN comes behind every number and null behind NaN, either way.

    Returns:
        ``group_key``, ``item_id``, ``rank`` (from 1). The same rows on every run. An empty table gives none.
    """
    key = F.col(group) if isinstance(group, str) else group
    names = [f"k{i}" for i in range(2 * len(order) + 1)]
    rows = df.select(key.cast("string").alias("g"), *[k.alias(c) for k, c in zip(_keys(order, id_column), names)])
    rows = rows.where(F.col("g").isNotNull() & F.col(names[-1]).isNotNull())
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def chunked(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= chunk:
                    yield from work(held, names, n)
                    held, size = [], 0
            if size:
                yield from work(held, names, n)

        return run

    sort_key = F.struct(*names)
    found = (
        rows.mapInArrow(chunked(_bounds), f"{shape}, n_rows bigint")
        .groupBy("g")
        .agg(F.min(sort_key).alias("bound"), F.sum("n_rows").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "g")
        .limit(BROADCAST_BOUNDS)
        .select("g", "bound")
    )
    within = rows.join(F.broadcast(found), "g", "left").where(F.col("bound").isNull() | (sort_key <= F.col("bound"))).select("g", *names)
    survivors = within.mapInArrow(chunked(_pruned), shape)
    items = survivors.groupBy("g", F.col(names[-1]).alias("item_id")).agg(F.min(sort_key).alias("key"))
    best = Window.partitionBy("g").orderBy("key")
    return (
        items.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select(F.col("g").alias("group_key"), "item_id", "rank")
    )


def _ranked(rows: pa.Table, names: list[str], at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best row of each item of the groups with so many rows, by group and key: rows, group codes, and where each group
    begins; at last the rows of each code."""
    coded = rows.column("g").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    picked = np.flatnonzero(counts[codes] >= at_least)
    keys = [rows.column(c).to_numpy()[picked] for c in names]
    codes = codes[picked]
    # one row an item: its best
    by_item = np.lexsort([*keys[-2::-1], keys[-1], codes])
    g, i = codes[by_item], keys[-1][by_item]
    own = by_item[np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]] if g.size else by_item
    own = own[np.lexsort([*[k[own] for k in keys[::-1]], codes[own]])]
    g = codes[own]
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if g.size else np.zeros(0, np.int64)
    return picked[own], g, begins, counts


def _bounds(held: list[pa.RecordBatch], names: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """For each group with at least n different items in these rows its n-th best sort key, and its number of rows."""
    rows = pa.Table.from_batches(held).combine_chunks()
    ranked, codes, begins, counts = _ranked(rows, names, n)
    sizes = np.diff(np.r_[begins, codes.size])
    nth = (begins + n - 1)[sizes >= n]
    if nth.size:
        picked = rows.take(pa.array(ranked[nth])).combine_chunks()
        columns = [picked.column(c).chunk(0) for c in ("g", *names)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[codes[nth]].astype(np.int64))], ["g", *names, "n_rows"])


def _pruned(held: list[pa.RecordBatch], names: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """The n best items of each group among these rows."""
    rows = pa.Table.from_batches(held).combine_chunks()
    ranked, codes, begins, _ = _ranked(rows, names, 1)
    sizes = np.diff(np.r_[begins, codes.size])
    first = np.arange(codes.size) - np.repeat(begins, sizes) < n
    yield from rows.take(pa.array(ranked[first])).to_batches()
