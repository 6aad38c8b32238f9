"""Gene positions: a table unique on protein_id, its stored form, and lookups in it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import clean_id
from seqloom.functions.sequence import contig_of
from seqloom.sources.formats import keep_one


def positions_from_genes(genes: DataFrame, last: bool = True) -> DataFrame:
    """``protein_id, start, end, strand, contig_id`` from a gene scan; of repeated ids the last (or first) counts.

    The contig is the id without a trailing ``_number``.
    """
    kept = keep_one(genes.select("protein_id", "start", "end", "strand", "file_path", "record_rank"), "protein_id", last)
    return kept.select("protein_id", "start", "end", "strand", contig_of("protein_id", when_numeric=True).alias("contig_id"))


def positions_from_features(features: DataFrame) -> DataFrame:
    """Positions from the CDS rows of a feature scan that have an ID; the first row of an id counts.

    protein_id is the contig, '_' and the last '_' part of the ID. Any strand but '+' is -1.
    """
    rows = features.where((F.col("feature_type") == "CDS") & (F.coalesce(F.col("attributes")["ID"], F.lit("")) != ""))
    rows = rows.select(
        F.concat_ws("_", "seqid", F.substring_index(F.col("attributes")["ID"], "_", -1)).alias("protein_id"), "start", "end",
        F.when(F.col("strand") == "+", 1).otherwise(-1).cast("tinyint").alias("strand"), F.col("seqid").alias("contig_id"),
        "file_path", "record_rank",
    )
    return keep_one(rows, "protein_id", last=False).select("protein_id", "start", "end", "strand", "contig_id")


def current_positions(proteins: DataFrame) -> DataFrame:
    """Positions from the proteins table: of each id the row loaded last, whether removed or not.

    Rows loaded at the same time are told apart by their limits, the largest first. Null and blank ids are left out.
    """
    rows = proteins.select(clean_id("protein_id").alias("protein_id"), "start", "end", "strand", clean_id("contig_id").alias("contig_id"), "loaded_at")
    rows = rows.where(F.col("protein_id").isNotNull())
    newest = F.max_by(F.struct("start", "end", "strand", "contig_id"), F.struct("loaded_at", "start", "end", "strand", "contig_id"))
    return rows.groupBy("protein_id").agg(newest.alias("x")).select("protein_id", "x.*")


def write_index(positions: DataFrame, path: str, partitions: int | None = None) -> str:
    """Stores positions sorted by protein_id, so that lookups read few row groups; replaces what is there."""
    spread = positions.repartitionByRange(partitions, "protein_id") if partitions else positions.repartitionByRange("protein_id")
    spread.sortWithinPartitions("protein_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#protein_id", "true").parquet(path)
    return path


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index; an error if there is none."""
    return spark.read.parquet(path)


def get_position(positions: DataFrame, protein_id: str) -> DataFrame:
    """The row of one id, none if absent; the filter is pushed into the scan."""
    return positions.where(F.col("protein_id") == protein_id)


def get_positions(positions: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """The rows of the given ids (a table with ``protein_id``, or a few names); repeated and unknown ids add none."""
    if not isinstance(ids, DataFrame):
        return positions.where(F.col("protein_id").isin(list(ids)))
    return positions.join(ids.select("protein_id"), "protein_id", "left_semi")


def positions_on_contig(positions: DataFrame, contig_id: str) -> DataFrame:
    return positions.where(F.col("contig_id") == contig_id).orderBy("start", "protein_id")


def contains(positions: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (with ``protein_id``) and whether each is there."""
    known = positions.select("protein_id").distinct().withColumn("found", F.lit(True))
    return ids.join(known, "protein_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def index_stats(positions: DataFrame) -> DataFrame:
    return positions.agg(F.count("*").alias("n_proteins"), F.countDistinct("contig_id").alias("n_contigs"))
