"""A mixture of sources with target shares, by fitting subset sums to token budgets.

The total is the largest at which every source can give its share within its cap of repeats. A source's budget is
then made of whole passes over its documents and a remainder, which is met by counts of documents by exact token
length: most of it by a seeded draw, the last stretch by a bounded-knapsack dynamic program over the lengths left.
Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import shared_checkpoint

#: Tokens of a budget that are left to the dynamic program; 32 times the mean length of a source where that is more.
STRETCH = 16_384
#: Hash buckets of a (source, length) group, so that a frequent length is never ranked in one task.
BUCKETS = 4_096


def source_name(column: Column | str) -> Column:
    """A source's name without surrounding white space and in lower case; null if nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def bounded_knapsack(budget: int, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many items of each length to take, at most counts, for the largest sum that isn't above the budget."""
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    # Counts are split into powers of two, so that each part is taken or not.
    parts = []
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        n, k = min(n, budget // size), 1
        while n > 0:
            k = min(k, n)
            parts.append((i, k, k * size))
            n -= k
            k *= 2
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)  # the part that first reached a sum
    for p, (_, _, size) in enumerate(parts):
        if size <= budget:
            new = np.zeros(budget + 1, bool)
            new[size:] = reached[: budget + 1 - size]
            new &= ~reached
            by[new] = p
            reached |= new
            if reached[budget]:
                break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, k, size = parts[by[at]]
        taken[i] += k
        at -= size
    return taken


def fit_budget(budget: int, lengths: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Counts by length whose sum comes as near to the budget as the lengths allow, from below."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    mean = max(1, total // max(1, int(counts.sum())))
    stretch = min(budget, max(STRETCH, 32 * mean))
    # The draw: the same fraction of each length, rounded at random.
    goal = budget - stretch
    exact = counts * (goal / total)
    taken = np.floor(exact).astype(np.int64)
    taken += np.random.default_rng(seed).random(len(lengths)) < exact - taken
    taken = np.minimum(taken, counts)
    for i in np.argsort(-lengths, kind="stable"):  # the rounding may overshoot
        over = int((lengths * taken).sum()) - budget
        if over <= 0:
            break
        taken[i] -= min(int(taken[i]), -(-over // int(lengths[i])))
    # Whole documents, longest first, until the dynamic program's stretch is left.
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= stretch:
            break
        more = min(int(counts[i] - taken[i]), (left - stretch) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    return taken + bounded_knapsack(left, lengths, counts - taken)


def mixture_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: its tokens, its share among the sources with documents, and its budget.

    The table has as many rows as ``targets``. Shares of sources without documents go to the others in proportion.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens").cast("bigint")).alias("n_tokens"))
    # A target named twice counts once, with the sum of its shares and the smaller cap.
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    plan = wanted.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).join(have, "source", "left")
    plan = plan.na.fill({"n_documents": 0, "n_tokens": 0})
    everything = Window.partitionBy(F.lit(0))  # as many rows as targets
    share = F.when(F.col("n_tokens") > 0, F.col("target_share")) / F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(everything)
    plan = plan.withColumn("share", F.coalesce(share, F.lit(0.0)))
    total = F.min(F.when(F.col("share") > 0, F.col("n_tokens") * F.col("max_repeats") / F.col("share"))).over(everything)
    return plan.withColumn("budget", F.coalesce(F.floor(total * F.col("share") + F.lit(1e-6)).cast("bigint"), F.lit(0)))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture's documents and the report of shares.

    Args:
        documents: ``source`` (as in targets), ``doc_id`` (bigint, unique) and ``n_tokens``; others are ignored.
            Documents with a null source or id, or without tokens, take no part; nor do sources without a target.
        targets: ``source``, ``target_share``, ``max_repeats``.

    Returns:
        The mixture ``source, doc_id, n_tokens, times`` (times from 1 to max_repeats), and per target ``source,
        target_share, max_repeats, n_documents, n_tokens, budget, used_documents, used_tokens, actual_share``. A
        source with a target but no documents stays in the report with an actual share of 0.
    """
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    sizes = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0)).select("source", "doc_id", F.col("n_tokens").cast("int").alias("n_tokens"))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int")
    sizes = shared_checkpoint(sizes.withColumn("bucket", bucket))
    plan = shared_checkpoint(mixture_plan(sizes, wanted))

    # Lengths of a source: as many rows as there are different token counts.
    lengths = sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    fitted = (
        lengths.join(F.broadcast(plan.select("source", "budget", F.col("n_tokens").alias("all_tokens"))), "source")
        .groupBy("source")
        .applyInPandas(_fitter(seed), "source string, n_tokens int, passes int, extra bigint")
    )
    # Within a length, the documents with the smallest hashes are used once more: whole buckets, then a ranked one.
    cells = sizes.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(fitted, ["source", "n_tokens"])
    cells = cells.select("source", "n_tokens", "bucket", "passes", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), "n").alias("more"), (F.col("n") > F.greatest(F.col("extra") - F.col("before"), F.lit(0))).alias("split"))
    rows = sizes.join(cells, ["source", "n_tokens", "bucket"])
    ranked = Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    cut = rows.where("split and more > 0").withColumn("once", F.row_number().over(ranked) <= F.col("more"))
    rest = rows.where("not split or more = 0").withColumn("once", F.col("more") > 0)
    used = cut.unionByName(rest).withColumn("times", F.col("passes") + F.col("once").cast("int"))
    mixture = used.where("times > 0").select("source", "doc_id", "n_tokens", "times")

    spent = mixture.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("n_tokens").cast("bigint") * F.col("times")).alias("used_tokens"))
    report = plan.drop("share").join(spent, "source", "left").na.fill({"used_documents": 0, "used_tokens": 0})
    everything = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # as many rows as targets
    return mixture, report.withColumn("actual_share", F.when(everything > 0, F.col("used_tokens") / everything).otherwise(F.lit(0.0)))


def _fitter(seed: int):
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens", ignore_index=True)
        budget, total = int(rows["budget"].iloc[0]), int(rows["all_tokens"].iloc[0])
        passes, left = divmod(budget, total)
        extra = fit_budget(left, rows["n_tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), seed)
        return pd.DataFrame({"source": key[0], "n_tokens": rows["n_tokens"], "passes": passes, "extra": extra})

    return fit
