"""Recurring analyses of located hits: statistics, best hits, bins, pivots and relational division."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group ``n, mean, min, max, std`` (sample; null for one row) and ``n_distinct`` of a numeric column."""
    c = F.col(value)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.stddev_samp(c).alias("std"), F.countDistinct(c).alias("n_distinct"),
    )


def groups_having(df: DataFrame, by: Sequence[str], value: str, mean_above: float, at_least: int) -> DataFrame:
    """The groups whose mean is above a limit and that have at least so many rows."""
    stats = group_stats(df, by, value)
    return stats.where((F.col("mean") > mean_above) & (F.col("n") >= at_least))


#: Quantiles of a description, and the accuracy of their first, approximate search: a rank is found to rows / ACCURACY.
QUANTILES, ACCURACY = (0.25, 0.5, 0.75), 10_000


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column ``n, n_null, n_distinct, mean, std, min, q25, median, q75, max``; quantiles are exact, with linear interpolation.

    NaN counts as a value above every number. Values are counted before they are ordered, and only those near an approximate
    quantile are ordered at all, so no task holds a column. A column without values has counts of 0 and nulls.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    margin = 1.5 / ACCURACY
    ranks = [min(max(q + d, 0.0), 1.0) for q in QUANTILES for d in (-margin, margin)]
    stats = rows.groupBy("column").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.percentile_approx("x", ranks, ACCURACY).alias("near"),
    )
    counted = rows.where(F.col("x").isNotNull()).groupBy("column", "x").agg(F.count("*").alias("k"))
    # As many rows as columns are described.
    brackets = F.broadcast(stats.select("column", "n", "near"))
    limits = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("near")[2 * i].alias("low"), F.col("near")[2 * i + 1].alias("high"), ((F.col("n") - 1) * q).alias("rank")) for i, q in enumerate(QUANTILES)]))
    placed = counted.join(brackets, "column").select("column", "x", "k", limits.alias("b")).select("column", "x", "k", "b.*")
    below = placed.where(F.col("x") < F.col("low")).groupBy("column", "i").agg(F.sum("k").alias("below"))
    inside = placed.where(F.col("x").between(F.col("low"), F.col("high"))).join(F.broadcast(below), ["column", "i"], "left")
    upto = F.coalesce("below", F.lit(0)) + F.sum("k").over(Window.partitionBy("column", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", upto)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    found = inside.groupBy("column", "i").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    share = F.col("rank") - F.floor("rank")
    value = F.when(share == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * share)
    names = ("q25", "median", "q75")
    quantiles = found.groupBy("column").agg(*[F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(names)])
    distinct = counted.groupBy("column").agg(F.count("*").alias("n_distinct"))
    made = stats.join(F.broadcast(distinct), "column", "left").join(F.broadcast(quantiles), "column", "left")
    return made.select("column", "n", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mean", "std", "min", *names, "max")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r``: Pearson's correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(stacked.alias("x")).select("x.*")


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order, which should end in a unique column. Adds ``rank``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_alignment_columns(alignments: DataFrame) -> DataFrame:
    """``identity`` (share of equal letters) and the quality bands: ``is_exact`` (no mismatch, 12 letters or more) and
    ``is_short`` (9 to 15 letters, at most one mismatch); an alignment may be in both."""
    n, wrong = F.col("length"), F.col("mismatches")
    return alignments.withColumns({"identity": 1 - wrong / n, "is_exact": (wrong == 0) & (n >= 12), "is_short": n.between(9, 15) & (wrong <= 1)})


def with_hit_columns(hits: DataFrame) -> DataFrame:
    """The usual derived columns of located hits.

    ``length``, ``is_forward``, ``neg_log_evalue`` (-300 where the E-value is 0), ``identity_bin`` (0, 80], (80, 90],
    (90, 95], (95, 100], null outside), ``length_class`` (short below 300, long from 1000) and ``location``.
    """
    length = F.abs(F.col("end") - F.col("start")) + 1
    p = F.col("pident")
    bins = F.when((p > 0) & (p <= 80), "low").when((p > 80) & (p <= 90), "medium").when((p > 90) & (p <= 95), "high").when((p > 95) & (p <= 100), "very_high")
    return hits.withColumns(
        {
            "length": length,
            "is_forward": F.col("strand") == 1,
            "neg_log_evalue": -F.when(F.col("evalue") > 0, F.log10("evalue")).when(F.col("evalue") == 0, 300.0),
            "identity_bin": bins,
            "length_class": F.when(length < 300, "short").when(length < 1000, "medium").otherwise("long"),
            "location": F.concat(F.col("contig_id"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end")),
        }
    )


def count_table(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by ``row`` with one column for each of ``values`` (a fixed list), 0 where there are none."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def present_in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """The items that occur in every group: relational division by counting."""
    pairs = df.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(item, group).distinct()
    everything = pairs.agg(F.countDistinct(group).alias("n_all"))
    counts = pairs.groupBy(item).agg(F.count("*").alias("n_groups"))
    return counts.join(F.broadcast(everything), F.col("n_groups") == F.col("n_all")).drop("n_all")  # one row


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin`` (from 0; the last holds its upper edge), ``low_edge`` and ``n`` of the values within the limits."""
    x = F.col(value).cast("double")
    width = (high - low) / bins
    number = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(~F.isnan(x) & (x >= low) & (x <= high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n")).withColumn("low_edge", low + F.col("bin") * width)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
