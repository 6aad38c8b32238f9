"""Sequence search results: greedy removal of near-identical hits, best first, and headers of hits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import shared_checkpoint
from seqloom.functions.sequence import sequence_identity

#: Letters of sequences that a task compares at once.
LETTERS_AT_ONCE = 4_000_000


def deduplicate_hits(hits: DataFrame, threshold: float = 0.95, at_once: int = 500, rows_per_task: int = 100_000) -> DataFrame:
    """Per query, best score first, the hits that are less than ``threshold`` identical to every kept one.

    A query with up to ``at_once`` different sequences is settled in one step. A larger one takes rounds: its best
    ``at_once`` hits that are still open are settled in one task, and those of them that are kept then meet all its open
    hits, spread over tasks, and drop what is near to them. So no task holds a query, and the result is that of one pass.

    Args:
        hits: ``query_id``, ``hit_id`` (breaks ties between equal scores), ``bit_score``, ``sequence``; others are ignored.
        at_once: the most hits that are compared with each other in one row.
        rows_per_task: about the most open hits of one query that a task holds.

    Returns:
        ``query_id, hit_id, bit_score, sequence``. Hits without a sequence are left out, unless no hit of the query
        has one: then all stay. Rows with a null query_id form a query of their own. Repeated rows are one hit.
    """
    columns = ["query_id", "hit_id", "bit_score", "sequence"]
    rank = F.struct((-F.col("bit_score")).alias("worse"), "hit_id", "bit_score", "sequence")
    rows = hits.select("query_id", "hit_id", F.col("bit_score").cast("double"), F.nullif("sequence", F.lit("")).alias("sequence")).distinct()
    # Of equal sequences only the best can stay, whatever else is kept: copies are dropped on the map side, before a query's hits meet.
    if threshold <= 1:
        none = F.col("sequence").isNull()
        alone = [F.when(none, F.col(c)).alias(f"own {c}") for c in ("hit_id", "bit_score")]
        best = rows.groupBy("query_id", F.upper("sequence").alias("same"), *alone).agg(F.min(rank).alias("x"))
        rows = best.select("query_id", "x.hit_id", "x.bit_score", "x.sequence")
    rows = rows.withColumn("query", F.coalesce(F.concat(F.lit("q"), F.col("query_id").cast("string")), F.lit("")))
    sizes = rows.groupBy("query").agg(F.count("sequence").alias("n"))
    rows = shared_checkpoint(rows.join(sizes, "query"))  # nothing is grouped behind this join, so a query with most rows can be split in it
    found = F.col("sequence").isNotNull()
    if threshold > 1:  # nothing is that near
        return rows.where(found | (F.col("n") == 0)).select(*columns)
    kept = [rows.where("n = 0"), _greedy(rows.where(found & (F.col("n") <= at_once)), rank, threshold)]
    open_rows = rows.where(found & (F.col("n") > at_once))
    salts = F.ceil(F.col("n") / rows_per_task).cast("int")
    while not open_rows.isEmpty():
        heads = open_rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(rank))).where(F.col("place") <= at_once)
        leaders = shared_checkpoint(_greedy(heads, rank, threshold))
        kept.append(leaders)
        left = open_rows.withColumn("salt", F.pmod(F.xxhash64("hit_id", "sequence"), salts).cast("int"))
        right = leaders.select(F.col("query").alias("of"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"), F.upper("sequence").alias("same"))
        pairs = left.withColumn("same", F.upper("sequence")).groupBy("query", "salt").cogroup(right.groupBy("of", "part"))
        open_rows = shared_checkpoint(pairs.applyInArrow(lambda own, met: _far(own, met, threshold), open_rows.schema))
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in kept])


def _greedy(rows: DataFrame, rank: Column, threshold: float) -> DataFrame:
    """The kept hits of queries of bounded size, all with a sequence."""
    groups = rows.groupBy("query", "query_id", "n").agg(F.array_sort(F.collect_list(rank)).alias("all"))
    near = lambda kept, x: F.exists(kept, lambda y: sequence_identity(y["sequence"], x["sequence"]) >= threshold)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, x: F.when(near(done, x), done).otherwise(F.array_append(done, x)))
    return groups.select("query", "query_id", "n", F.explode(kept).alias("x")).select("query", "query_id", "n", "x.hit_id", "x.bit_score", "x.sequence")


def _far(rows: pa.Table, leaders: pa.Table, threshold: float) -> pa.Table:
    """The rows that are less than ``threshold`` identical to every leader; a leader is near to itself."""
    texts = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in rows.column("same").to_pylist()]
    heads = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in leaders.column("same").to_pylist()]
    size = np.array([len(x) for x in texts], np.int64)
    order, far, at = np.argsort(size, kind="stable"), np.ones(len(texts), bool), 0
    while at < len(order):
        # sorted by length: the last row of a portion is the longest
        widths = size[order[at:]] * np.arange(1, len(order) - at + 1)
        k = order[at : at + max(1, int(np.searchsorted(widths, LETTERS_AT_ONCE, "right")))]
        at += len(k)
        letters = np.full((len(k), size[k].max()), 2**32 - 1, np.uint32)
        for i, row in enumerate(k):
            letters[i, : size[row]] = texts[row]
        for head in heads:
            width = min(len(head), letters.shape[1])
            same = (letters[:, :width] == head[:width]).sum(axis=1)
            far[k] &= same / np.maximum(size[k], len(head)) < threshold
    return rows.filter(pa.array(far)).drop_columns(["salt", "same"])


def fasta_header(query: Column, *, identity: Column, evalue: Column, score: Column, with_metadata: bool = True) -> Column:
    """``>id identity=.. evalue=.. score=..``"""
    if not with_metadata:
        return F.concat(F.lit(">"), query)
    return F.format_string(">%s identity=%.2f evalue=%.2e score=%.1f", query, identity, evalue, score)
