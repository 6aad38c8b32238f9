"""Strand-aware coding, upstream and downstream regions of genes, as columns over genes joined to contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import slice_region


def extract_regions(genes: DataFrame, contigs: DataFrame, upstream: int = 350, downstream: int = 250, strict: bool = False) -> DataFrame:
    """``genes`` with the regions of each.

    Args:
        genes: ``contig_id, start, end, strand`` (1-based, both ends included) and any other columns, which stay.
        contigs: ``contig_id`` (unique) and ``sequence``.
        strict: raise an error for a bad gene instead of giving null regions.

    Returns:
        ``genes`` with ``problem`` (null for a good gene, else 'unknown_contig', 'start_below_1', 'end_beyond_contig',
        'start_after_end' or 'unknown_strand') and structs ``coding``, ``upstream`` and ``downstream`` of ``start``,
        ``end``, ``length`` and ``sequence``. On strand -1 upstream lies behind the gene and all sequences are the
        reverse complement. Regions are clipped to the contig; an empty one has end = start - 1.
    """
    right = contigs.select(F.col("contig_id").alias("the contig"), F.col("sequence").alias("the sequence"))
    rows = genes.join(right, F.col("contig_id") == F.col("the contig"), "left")
    start, end, strand, whole = F.col("start"), F.col("end"), F.col("strand"), F.col("the sequence")
    problem = (
        F.when(whole.isNull(), "unknown_contig")
        .when(start.isNull() | (start < 1), "start_below_1")
        .when(end.isNull() | (end > F.length(whole)), "end_beyond_contig")
        .when(start > end, "start_after_end")
        .when(~strand.isin(1, -1) | strand.isNull(), "unknown_strand")
    )
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("bad gene: "), problem))).otherwise(problem)
    forward = strand == 1
    left_of = lambda n: (F.greatest(start - n, F.lit(1)), start - 1)
    right_of = lambda n: (end + 1, F.least(end + n, F.length(whole)))

    def region(first: Column, last: Column) -> Column:
        n = F.greatest(last - first + 1, F.lit(0))
        made = F.struct(first.alias("start"), (first + n - 1).alias("end"), n.alias("length"), slice_region(whole, first, first + n - 1, strand).alias("sequence"))
        return F.when(F.col("problem").isNull(), made)

    def pick(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        return F.when(forward, region(*a)).otherwise(region(*b))

    return (
        rows.withColumn("problem", problem)
        .withColumns(
            {
                "coding": region(start, end),
                "upstream": pick(left_of(upstream), right_of(upstream)),
                "downstream": pick(right_of(downstream), left_of(downstream)),
            }
        )
        .drop("the contig", "the sequence")
    )


def transposon_record(regions: DataFrame, metadata: dict[str, Column] | None = None) -> DataFrame:
    """Regions as nested records: ``contig_id, strand, coordinates, sequences`` and, over them, the metadata columns."""
    parts = ("coding", "upstream", "downstream")
    limits = F.struct(*[F.struct(*[F.col(p)[f].alias(f) for f in ("start", "end", "length")]).alias(p) for p in parts])
    texts = F.struct(*[F.col(p)["sequence"].alias(p) for p in parts])
    columns = {"contig_id": F.col("contig_id"), "strand": F.col("strand"), "coordinates": limits, "sequences": texts} | (metadata or {})
    return regions.select(*[c.alias(name) for name, c in columns.items()])
