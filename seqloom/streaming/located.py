"""Search results that keep arriving: the same parsing and joining on a stream of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.locate import locate_hits
from seqloom.sources.formats import parse_features, parse_hits, parse_profile_hits


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("value")


def stream_protein_hits(spark: SparkSession, folder: str, positions: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Located hits of the files that arrive in a folder; stateless, so no watermark is needed.

    ``positions`` is a stored index (``positions.open_index``) or another table that doesn't number its rows.
    """
    return locate_hits(parse_hits(stream_lines(spark, folder, files_per_batch)), positions, "query_id")


def stream_profile_hits(spark: SparkSession, folder: str, positions: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    return locate_hits(parse_profile_hits(stream_lines(spark, folder, files_per_batch)), positions, "target_name")


def stream_features(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    return parse_features(stream_lines(spark, folder, files_per_batch))


def hits_per_window(hits: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Counts and best scores per subject and window of a time column; rows later than ``delay`` are left out."""
    return hits.withWatermark(time, delay).groupBy(F.window(time, window), "subject_id").agg(F.count("*").alias("n_hits"), F.max("bitscore").alias("best_bitscore"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there by now as Parquet, exactly once, and stops; call it again for what came since."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
