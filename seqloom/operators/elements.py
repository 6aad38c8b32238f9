"""Element records to guide-like alignments: flanks against noncoding regions, verdicts, and counts per element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import clean_id, latest_version
from seqloom.operators.alignments import Finder, align_pairs
from seqloom.operators.filters import Pipeline, apply_filters, summarise
from seqloom.operators.gapped import extend_with_gaps

ELEMENT_FINDER = Finder(min_length=8)


def element_pairs(elements: DataFrame) -> DataFrame:
    """Every flank with every noncoding region of its element; no shuffle, as both stand in one record.

    Returns:
        ``pair_id`` (struct of is_id, flanking_source and region index), the provenance columns, ``s1`` (flank) and
        ``s2`` (region). Empty and null sequences and null slots give no pair; the slots still count in the index.
        Missing starts, ends and types are 0 and ''; a missing length is that of the sequence. ``elements`` has one
        row per is_id.
    """
    flanks = F.explode(
        F.array(
            *[F.struct(F.lit(way).alias("flanking_source"), F.col(f"flanking_{way}.sequence").alias("s1")) for way in ("upstream", "downstream")]
        )
    )
    rows = elements.select("is_id", "sample", F.col("is_element.length").alias("is_length"), flanks.alias("f"), F.col("orf_annotation.noncoding_regions").alias("regions"))
    rows = rows.select("is_id", "sample", "is_length", "f.*", F.posexplode("regions").alias("region_index", "r"))
    rows = rows.where((F.length("s1") > 0) & (F.length("r.sequence") > 0))
    return rows.select(
        F.struct("is_id", "flanking_source", "region_index").alias("pair_id"),
        "is_id", "sample", "is_length", "flanking_source", "region_index",
        F.length("s1").alias("flanking_length"),
        F.coalesce("r.type", F.lit("")).alias("region_type"),
        F.coalesce("r.start", F.lit(0)).alias("noncoding_start"),
        F.coalesce("r.end", F.lit(0)).alias("noncoding_end"),
        F.coalesce("r.length", F.length("r.sequence")).alias("noncoding_length"),
        "s1", F.col("r.sequence").alias("s2"),
    )


def element_alignments(elements: DataFrame, finder: Finder = ELEMENT_FINDER, gaps: bool = False, min_identity: float = 0.8) -> DataFrame:
    """Alignments of all pairs of all elements, with their provenance; with ``gaps`` also their gapped extension, null below ``min_identity``."""
    found = align_pairs(element_pairs(elements).drop("pair_id"), finder)
    return extend_with_gaps(found, min_identity) if gaps else found.drop("s1", "s2")


def filter_inputs(alignments: DataFrame) -> DataFrame:
    """Alignments with the columns that filters read. A gapped extension goes before the ungapped match; the region's
    limits, not the hit's, are compared with the element's (from 1 to its length, 0 if missing)."""
    gapped = "gapped" in alignments.columns
    pick = lambda own, other: F.when(F.col("gapped").isNotNull(), own).otherwise(other) if gapped else other
    return alignments.withColumns(
        {
            "aligned_sequence": pick(F.replace(F.col("gapped.seq1_aligned"), F.lit("-"), F.lit("")), F.col("seq1")) if gapped else F.col("seq1"),
            "non_coding_start": F.col("noncoding_start"),
            "non_coding_end": F.col("noncoding_end"),
            "mismatches": pick(F.col("gapped.mismatches"), F.col("mismatches")) if gapped else F.col("mismatches"),
            "gaps": pick(F.col("gapped.gaps"), F.lit(0)) if gapped else F.lit(0),
            "alignment_string": pick(F.col("gapped.alignment_string"), F.lit("")) if gapped else F.lit(""),
            "query_length": F.col("flanking_length"),
            "target_length": F.col("noncoding_length"),
            "transposon_start": F.lit(1),
            "transposon_end": F.coalesce("is_length", F.lit(0)),
        }
    )


def process_elements(elements: DataFrame, pipeline: Pipeline | None = None, finder: Finder = ELEMENT_FINDER, gaps: bool = False) -> DataFrame:
    """One row per element: its counts, its alignments, and, with a pipeline, the counts of its verdicts.

    Returns:
        ``is_id, sample, is_element_length, num_noncoding_regions, total_hits`` and, with a pipeline, those of
        ``summarise`` (null for elements without alignments). Elements without hits stay, with 0.
    """
    found = element_alignments(elements, finder, gaps)
    counts = found.groupBy("is_id").agg(F.count("*").alias("total_hits"))
    if pipeline is not None:
        judged = apply_filters(filter_inputs(found), pipeline)
        counts = summarise(judged, pipeline, "is_id").withColumn("total_hits", F.col("total"))
    base = elements.select(
        "is_id", "sample", F.coalesce("is_element.length", F.lit(0)).alias("is_element_length"),
        F.coalesce(F.size("orf_annotation.noncoding_regions"), F.lit(0)).alias("num_noncoding_regions"),
    )
    base = base.withColumn("num_noncoding_regions", F.greatest("num_noncoding_regions", F.lit(0)))
    joined = base.join(counts, "is_id", "left")
    return joined.withColumn("total_hits", F.coalesce("total_hits", F.lit(0)))


def alignment_parts() -> list[Column]:
    """What of an element its alignments and their counts need: neither its own sequence nor its ORFs."""
    flanks = [F.struct(f"{c}.sequence").alias(c) for c in ("flanking_upstream", "flanking_downstream")]
    return [F.col("sample"), F.struct("is_element.length").alias("is_element"), *flanks, F.struct("orf_annotation.noncoding_regions").alias("orf_annotation")]


def newest_elements(elements: DataFrame, parts: Sequence[Column] | None = None) -> DataFrame:
    """The newest row of every is_id with all columns or the given ones, the id without surrounding spaces and tabs."""
    others = [c for c in elements.columns if c not in ("is_id",)] if parts is None else parts
    newest = latest_version(elements, clean_id("is_id"), F.col("loaded_at"), F.struct(*others))
    return newest.select(F.col("key").alias("is_id"), "payload.*")
