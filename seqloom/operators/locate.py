"""Search hits joined to gene positions and to the sequences they lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import contig_of, slice_region


def locate_hits(hits: DataFrame, positions: DataFrame, on: str, contig_from_id: bool = True) -> DataFrame:
    """Hits with the position of the protein in column ``on``; hits without one are left out (see ``unlocated``).

    Adds ``protein_id, start, end, strand, contig_id``, ``length`` and ``is_forward``. The contig is the protein id
    without its last ``_`` part, or the whole id. ``positions`` has one row per protein_id. Columns of these names
    in ``hits`` are replaced. Null ids match nothing.
    """
    made = ("protein_id", "start", "end", "strand", "contig_id", "length", "is_forward")
    key = F.col(on)
    left = hits.withColumn("the key", key).drop(*made)
    right = positions.select(F.col("protein_id").alias("the id"), "start", "end", "strand")
    joined = left.join(right, F.col("the key") == F.col("the id"))
    contig = contig_of("protein_id") if contig_from_id else F.col("protein_id")
    return (
        joined.withColumnRenamed("the id", "protein_id")
        .drop("the key")
        .withColumns({"contig_id": contig, "length": F.abs(F.col("end") - F.col("start")) + 1, "is_forward": F.col("strand") == 1})
    )


def unlocated(hits: DataFrame, positions: DataFrame, on: str) -> DataFrame:
    """The hits that ``locate_hits`` leaves out."""
    right = positions.select(F.col("protein_id").alias("the id"))
    return hits.join(right, F.col(on) == F.col("the id"), "left_anti")


def prefix_matches(keys: DataFrame, key: str, records: DataFrame, record_id: str) -> DataFrame:
    """All pairs of a key and a record whose id begins with it, by an equality join on the ids' prefixes.

    Args:
        keys: one row per key in column ``key``; blank and null keys match nothing.
        records: the records; only prefixes as long as some key are made.

    Returns:
        ``key`` and all columns of ``records``.
    """
    names = keys.select(F.col(key).alias("the key")).where(F.length("the key") > 0).distinct()
    # As many numbers as the keys have different lengths, so no more than the longest id has letters.
    lengths = sorted(r["n"] for r in names.select(F.length("the key").alias("n")).distinct().collect())
    # Ids are matched on their own, so that each record moves once for each key that it matches, not for each prefix.
    ids = records.select(F.col(record_id).alias("the id")).distinct()
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("the id"))
    prefixes = ids.select("the id", F.explode(F.transform(fitting, lambda n: F.substring(F.col("the id"), F.lit(1), n))).alias("the key"))
    found = prefixes.join(names, "the key")
    return records.join(found, F.col(record_id) == F.col("the id")).drop("the id").withColumnRenamed("the key", key)


def with_genomic_sequence(hits: DataFrame, records: DataFrame, order: Column) -> DataFrame:
    """Located hits with ``genomic_sequence``: the hit's bases on the first record whose id begins with its contig.

    A record on which the hit has no bases is passed over for the next one. Hits without such a record stay, with
    null. Reverse complement on strand -1. ``records`` has ``id`` and ``sequence``; ``order`` sorts them.
    """
    wanted = hits.select("contig_id", "start", "end", "strand").distinct()
    matched = prefix_matches(wanted.select("contig_id"), "contig_id", records.select("id", "sequence", order.alias("the order")), "id")
    sliced = wanted.join(matched, "contig_id").withColumn("genomic_sequence", slice_region("sequence", "start", "end", "strand"))
    keys = ["contig_id", "start", "end", "strand"]
    best = sliced.where(F.length("genomic_sequence") > 0).groupBy(keys).agg(F.min_by("genomic_sequence", "the order").alias("genomic_sequence"))
    return hits.drop("genomic_sequence").join(best, keys, "left")


def fetch_region(records: DataFrame, contig_id: str, start: int, end: int, strand: int, order: Column) -> DataFrame:
    """The bases of one region on the first matching record: one row, or none without such a record."""
    found = records.where(F.col("id").startswith(contig_id)).orderBy(order).limit(1)
    return found.select("id", slice_region("sequence", F.lit(start), F.lit(end), F.lit(strand)).alias("sequence"))


def with_target_sequence(hits: DataFrame, records: DataFrame, order: Column, context: int = 0) -> DataFrame:
    """Search hits with ``sequence``: the target's bases, widened by ``context``, on the last record whose id begins
    with target_id. No strand is looked at: a hit whose start lies behind its end gives '' unless the context spans it.
    """
    matched = prefix_matches(hits.select("target_id"), "target_id", records.select("id", "sequence", order.alias("the order")), "id")
    targets = matched.groupBy("target_id").agg(F.max_by("sequence", "the order").alias("whole"))
    part = slice_region("whole", F.col("target_start") - context, F.col("target_end") + context, F.lit(1))
    return hits.drop("sequence").join(targets, "target_id", "left").withColumn("sequence", part).drop("whole")


def retrieval_counts(hits: DataFrame, sequence: str) -> DataFrame:
    """One row: ``n_hits``, and ``n_found``, those whose sequence was found."""
    return hits.agg(F.count("*").alias("n_hits"), F.count(sequence).alias("n_found"))
