"""References to rows that are not there: missing, deleted, or arriving later.

References and the validity intervals of their parents are brought into the same partitions by key, sorted by time
in one stream (an interval's beginning before the references of the same instant), and merged in one linear pass.
The state of the pass is the latest end among the intervals that have begun: a reference is resolved exactly if that
end lies after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 00:00:00"


def orphan_references(refs: DataFrame, parents: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """References for which no parent row is in force at their time.

    Args:
        refs: columns ``ref_table``, ``ref_id``, ``key`` and ``at`` (timestamp); others are ignored.
        parents: columns ``key``, ``valid_from``, ``valid_to`` (null: still in force); others are ignored. A row
            is in force from valid_from, included, until valid_to, not included.
        rows_per_task: a key with more references than this is spread over several groups, each of which gets the
            key's (distinct) parent intervals.

    Returns:
        ``ref_table, ref_id, key, at, reason``, one row per reference. reason is 'missing' (no parent row of that
        key at all), 'deleted' (parents had been in force, all had ended by then), 'late' (the first parent comes
        into force only afterwards) or 'undated' (the reference has no time, though its key has a parent).
        References with a null key take no part; parents with a null key or valid_from are never in force.
        Repeated rows count once; if rows of one ref_id differ, the earliest unresolved one is given.
    """
    refs = refs.select("ref_table", "ref_id", "key", "at").where(F.col("key").isNotNull())
    kind = dict(refs.dtypes)["at"]
    parents = (
        parents.where(F.col("key").isNotNull() & F.col("valid_from").isNotNull())
        .select(
            "key",
            F.col("valid_from").cast(kind).alias("began"),
            F.coalesce(F.col("valid_to").cast(kind), F.lit(FOREVER).cast(kind)).alias("ends"),
        )
        .distinct()
    )
    # Hot keys: at most count(refs) / rows_per_task rows.
    hot = (
        refs.groupBy("key").count().where(F.col("count") > rows_per_task)
        .select("key", F.ceil(F.col("count") / rows_per_task).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    left = (
        refs.withColumn("row", F.monotonically_increasing_id())
        .join(F.broadcast(hot), "key", "left")
        .select("key", F.pmod(F.col("row"), salts).cast("int").alias("salt"), F.col("at").alias("t"), F.lit(1).alias("is_ref"),
                F.lit(None).cast(kind).alias("ends"), "ref_table", "ref_id")
    )
    right = (
        parents.join(F.broadcast(hot), "key", "left")
        .select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("began").alias("t"), F.lit(0).alias("is_ref"),
                "ends", F.lit(None).cast(dict(refs.dtypes)["ref_table"]).alias("ref_table"), F.lit(None).cast(dict(refs.dtypes)["ref_id"]).alias("ref_id"))
    )
    group = Window.partitionBy("key", "salt").orderBy("t", "is_ref")
    merged = left.unionByName(right).withColumns(
        {
            "reach": F.max("ends").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "known": F.max(F.col("is_ref") == 0).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    reason = (
        F.when(~F.col("known"), "missing")
        .when(F.col("t").isNull(), "undated")
        .when(F.col("reach").isNotNull(), "deleted")
        .otherwise("late")
    )
    resolved = F.col("t").isNotNull() & F.coalesce(F.col("reach") > F.col("t"), F.lit(False))
    return (
        merged.where((F.col("is_ref") == 1) & ~resolved)
        .groupBy("ref_table", "ref_id")
        .agg(F.min(F.struct(F.col("t").alias("at"), "key", reason.alias("reason"))).alias("x"))
        .select("ref_table", "ref_id", "x.key", "x.at", "x.reason")
    )


def orphans_by_period(orphans: DataFrame, unit: str = "month") -> DataFrame:
    """The number of orphan references per table, period of their time (null if they have none) and reason."""
    return orphans.groupBy("ref_table", F.date_trunc(unit, "at").alias("period"), "reason").agg(F.count("*").alias("n_orphans"))
