"""The usual workflows from files to results. They only build plans, but for small counts that a plan depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.elements import element_alignments, filter_inputs
from seqloom.operators.filters import Pipeline, apply_filters, default_pipeline
from seqloom.operators.locate import locate_hits, with_genomic_sequence, with_target_sequence
from seqloom.operators.positions import positions_from_genes
from seqloom.operators.regions import extract_regions
from seqloom.operators.search import deduplicate_hits
from seqloom.sources import formats
from seqloom.sources.sinks import PROTEIN_HIT_COLUMNS, hit_table


def located_hit_table(spark: SparkSession, genes: formats.Paths, hits: formats.Paths, contigs: formats.Paths) -> DataFrame:
    """Gene FASTA, search hits and contig FASTA to the exported table of located hits with their sequences."""
    positions = positions_from_genes(formats.read_gene_proteins(spark, genes))
    located = locate_hits(formats.read_protein_hits(spark, hits), positions, "query_id")
    records = formats.read_fasta(spark, contigs)
    return hit_table(with_genomic_sequence(located, records, F.struct("file_path", "record_rank")), PROTEIN_HIT_COLUMNS)


def hit_summary(hits: DataFrame, max_evalue: float = 1e-5, min_identity: float = 30.0) -> DataFrame:
    """Located forward hits under an E-value and above an identity, counted and averaged per subject."""
    good = hits.where((F.col("evalue") < max_evalue) & (F.col("pident") > min_identity) & (F.col("strand") == 1))
    return good.groupBy("subject_id").agg(
        F.count("*").alias("n_hits"), F.avg("pident").alias("mean_pident"), F.min("evalue").alias("best_evalue"), F.max("bitscore").alias("best_bitscore")
    )


def guide_candidates(elements: DataFrame, pipeline: Pipeline | None = None, gaps: bool = False) -> DataFrame:
    """Elements to the alignments that pass the filters, with E-value and confidence."""
    judged = apply_filters(filter_inputs(element_alignments(elements, gaps=gaps)), pipeline or default_pipeline())
    passed = judged.where("verdict.pass")
    return passed.withColumns({"e_value": F.col("verdict.metrics.e_value"), "confidence": F.col("verdict.confidence")})


def with_families(candidates: DataFrame, annotations: DataFrame) -> DataFrame:
    """Candidates with their elements' families: distinct, sorted, joined by ', '; null where none is known.

    ``annotations`` has ``is_id, orf_id, is_family``; of an ORF's rows the one with the least family counts.
    """
    orfs = annotations.groupBy("is_id", "orf_id").agg(F.min(F.nullif("is_family", F.lit(""))).alias("is_family"))
    families = orfs.groupBy("is_id").agg(F.array_join(F.array_sort(F.collect_set("is_family")), ", ").alias("families"))
    return candidates.join(families, "is_id", "left").withColumn("families", F.nullif("families", F.lit("")))


def searched_sequences(hits: DataFrame, records: DataFrame, order, context: int = 0, threshold: float = 0.95) -> DataFrame:
    """External search hits to their target sequences without near copies. ``hits`` also has ``hit_id``."""
    found = with_target_sequence(hits, records, order, context)
    return deduplicate_hits(found, threshold)


def listed_regions(proteins: DataFrame, positions: DataFrame, contigs: DataFrame, upstream: int = 350, downstream: int = 250) -> DataFrame:
    """A list of proteins (``protein_id``) to their regions; proteins without a position are left out."""
    return extract_regions(proteins.join(positions, "protein_id"), contigs, upstream, downstream)


def candidates_by_element(candidates: DataFrame) -> DataFrame:
    """One row per element with its candidates in order; an element's candidates are bounded by its own letters."""
    rank = F.struct("flanking_source", "region_index", "pos1", "pos2", "length", "orientation", "e_value", "confidence")
    return candidates.groupBy("is_id").agg(F.count("*").alias("n_candidates"), F.sort_array(F.collect_list(rank)).alias("alignments"))


def joined_candidates(candidates: DataFrame, elements: DataFrame, max_length: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Candidates with their element's record, for elements up to a length, and the candidates without a record."""
    names = [c for c in elements.columns if c not in candidates.columns or c in ("sample", "is_id")]
    short = elements.select(*names).where(F.coalesce("is_element.length", F.lit(0)) <= max_length)
    keys = ["sample", "is_id"]
    return candidates.join(short, keys), candidates.join(elements.select(keys).distinct(), keys, "left_anti")
