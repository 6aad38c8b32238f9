"""Merging of overlapping intervals into continuous periods, and the gaps between them.

Intervals are closed: both ends belong to them, and an interval that begins one after another ends continues it.

Entities of any size are merged in two levels. An entity with more than ``rows_per_shard`` intervals is cut, at
quantiles of its starts, into shards; its intervals are clipped into the shards they touch and merged there, shard
by shard. Periods strictly inside a shard are then final. Only the first and the last period of a shard can touch
coverage of another shard, so only these (two rows a shard) are stitched per entity and coalesced across the shard
boundaries. No task ever holds more of a huge entity than one shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import shared_checkpoint


def merge_intervals(
    df: DataFrame, entity: Sequence[str], start: str, end: str, rows_per_shard: int = 1_000_000
) -> DataFrame:
    """Continuous periods and the gaps between neighbouring periods, per entity.

    Args:
        df: the intervals; columns beyond the named ones are ignored, whatever their names.
        entity: the columns that name an entity.
        start, end: whole-number columns, both included.
        rows_per_shard: an entity with more rows than this is merged in shards.

    Returns:
        The entity columns, ``span_kind`` ('period' or 'gap'), ``span_start`` and ``span_end`` (bigint).
        Rows with a null in an entity column, a null limit, or start > end take no part. Repeated rows count
        once. An entity with one period has no gap; an empty table gives an empty result.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        F.col(start).cast("bigint").alias("s"),
        F.col(end).cast("bigint").alias("e"),
    ).where(F.col("s") <= F.col("e"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())

    # The cuts are approximate quantiles; kept, so that every use of them sees the same ones.
    cuts, parts = _cuts(rows, keys, rows_per_shard)
    pieces = _clip(rows, keys, shared_checkpoint(cuts), parts)
    islands = _merge_sorted(pieces, [*keys, "shard", "sharded"])

    # Level 1: what lies inside one shard.
    in_shard = Window.partitionBy(*keys, "shard", "sharded").orderBy("s")
    islands = islands.withColumns({"before": F.lag("e").over(in_shard), "after": F.lead("s").over(in_shard)})
    edge = F.col("sharded") & (F.col("before").isNull() | F.col("after").isNull())
    inner = islands.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~edge, _span("period", F.col("s"), F.col("e"))),
                    F.when(F.col("after").isNotNull(), _span("gap", F.col("e") + 1, F.col("after") - 1)),
                )
            )
        ).alias("span"),
    ).select(*keys, "span.*")

    # Level 2: at most two periods a shard, stitched where they touch across a shard boundary.
    across = Window.partitionBy(*keys).orderBy("s")
    edges = (
        islands.where(edge)
        .select(*keys, "shard", "s", "e")
        .withColumns({"before": F.lag("e").over(across), "before_shard": F.lag("shard").over(across)})
    )
    jump = F.col("before").isNotNull() & (F.col("before_shard") != F.col("shard")) & (F.col("s") - 1 > F.col("before"))
    gaps = edges.where(jump).select(*keys, _span("gap", F.col("before") + 1, F.col("s") - 1).alias("span"))
    new = F.when(F.col("before").isNull() | (F.col("s") - 1 > F.col("before")), 1).otherwise(0)
    stitched = (
        edges.withColumn("period", F.sum(new).over(across))
        .groupBy(*keys, "period")
        .agg(_span("period", F.min("s"), F.max("e")).alias("span"))
    )
    outer = stitched.select(*keys, "span").unionByName(gaps).select(*keys, "span.*")
    return inner.unionByName(outer).select(
        *[F.col(k).alias(c) for k, c in zip(keys, entity)], "span_kind", "span_start", "span_end"
    )


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("span_kind"), start.alias("span_start"), end.alias("span_end"))


def _cuts(rows: DataFrame, keys: list[str], rows_per_shard: int) -> tuple[DataFrame, int]:
    """The first positions of shards 1, 2, ... of every huge entity: at most rows / rows_per_shard of them in all; and the
    most shards that an entity has."""
    huge = rows.groupBy(*keys).count().where(F.col("count") > rows_per_shard)
    most = huge.agg(F.max("count")).first()[0] or 0  # one number: how many cuts the largest entity needs
    parts = max(2, -(-most // rows_per_shard))
    wanted = F.greatest(F.ceil(F.col("count") / rows_per_shard).cast("int"), F.lit(2))
    picked = F.transform(
        F.sequence(F.lit(1), wanted - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.least((i * parts / wanted).cast("int"), F.lit(parts - 1))))
    )
    cuts = (
        rows.join(F.broadcast(huge), keys)
        .groupBy(*keys)
        .agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("q"), F.max("count").alias("count"))
        .select(*keys, F.array_sort(F.array_distinct(picked)).alias("cuts"))
    )
    return cuts, parts


def _clip(rows: DataFrame, keys: list[str], cuts: DataFrame, parts: int) -> DataFrame:
    """One piece for each shard that an interval touches; pieces of a shard with the same start become the longest."""
    at = rows.join(F.broadcast(cuts), keys, "left")

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])

    def shard_of(x: Column) -> Column:
        """The number of cuts up to x, by halving: an entity may have very many. Beyond the last cut F.get gives null."""
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("cuts", n + step - 1) <= x, n + step).otherwise(n))

    first_of = F.when(F.col("shard") == 0, F.col("s")).otherwise(F.element_at("cuts", F.greatest(F.col("shard"), F.lit(1))))
    last_of = F.when(F.col("shard") >= F.size("cuts"), F.col("e")).otherwise(
        F.element_at("cuts", F.least(F.col("shard") + 1, F.size("cuts"))) - 1
    )
    whole = F.col("cuts").isNull()
    pieces = (
        at.withColumn("shard", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(shard_of(F.col("s")), shard_of(F.col("e"))))))
        .withColumn("from", F.when(whole, F.col("s")).otherwise(F.greatest(F.col("s"), first_of)))
        .withColumn("to", F.when(whole, F.col("e")).otherwise(F.least(F.col("e"), last_of)))
    )
    return pieces.groupBy(*keys, "shard", (~whole).alias("sharded"), F.col("from").alias("s")).agg(F.max("to").alias("e"))


def _merge_sorted(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Sweeps the pieces of each group in order of their starts and joins what overlaps or adjoins."""
    order = Window.partitionBy(*by).orderBy("s")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("reach").isNull() | (F.col("s") - 1 > F.col("reach")), 1).otherwise(0)
    return (
        pieces.withColumn("reach", reach)
        .withColumn("island", F.sum(new).over(order))
        .groupBy(*by, "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("island")
    )
