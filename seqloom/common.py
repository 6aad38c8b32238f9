"""Small helpers shared by all operators: table access, id cleaning, shared-folder checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(column: Column | str) -> Column:
    """An id without the spaces and tabs around it; null if nothing is left. Letter case is kept."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.btrim(c, F.lit(" \t")), F.lit(""))


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the folder that spark.checkpoint.dir names.

    Where the session names none, a local session gets a folder of this machine; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def latest_version(df: DataFrame, key: Column, version: Column, payload: Column) -> DataFrame:
    """Per key the payload of its newest row, as columns ``key`` and ``payload``.

    Rows with a null key take no part. Exact copies are one row. Rows of one key and version that differ are told apart
    by a hash of the whole row, so that every run and every payload takes the same one; maps aren't looked at. A null version
    is the oldest. The aggregation combines on the map side, so a key with very many versions costs no skew.
    """
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rank = F.struct(version.alias("version"), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias("mark"))
    rows = df.select(key.alias("key"), rank.alias("rank"), payload.alias("payload")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.max_by("payload", "rank").alias("payload"))
