"""Queries of the numbered problems 1 and 6 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import clean_id, latest_version, table
from seqloom.llm.mixing import mix_sources, source_name
from seqloom.llm.packing import pack_items
from seqloom.llm.spans import shared_shares, shared_spans
from seqloom.llm.splitting import split_texts
from seqloom.llm.tokens import token_counts
from seqloom.llm.topn import top_n_per_group


def _limit(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, "size_limits").where(F.col("limit_name") == name).first()["n_tokens"]


# Problem 1


def _best(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "diamond_hits").where(F.col("bitscore").isNotNull() & ~F.isnan("bitscore"))
    return top_n_per_group(hits, clean_id("query_id"), "hit_id", [("bitscore", "desc"), ("evalue", "asc")], 5)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select(F.col("group_key").alias("query_id"), F.col("item_id").alias("hit_id"))


def p1_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select(F.col("group_key").alias("query_id"), F.col("item_id").alias("hit_id"), "rank")


# Problem 6


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    regions = F.transform(
        F.col("orf_annotation.noncoding_regions"),
        lambda x, i: F.struct(F.lit("noncoding_regions").alias("part"), i.cast("int").alias("no"), x["sequence"].alias("letters")),
    )
    flank = F.struct(F.lit("flanking_upstream").alias("part"), F.lit(0).alias("no"), F.col("flanking_upstream.sequence").alias("letters"))
    parts = F.concat(F.array(flank), F.coalesce(regions, F.array().cast("array<struct<part: string, no: int, letters: string>>")))
    newest = latest_version(table(spark, sf, "is_elements"), clean_id("is_id"), F.col("loaded_at"), parts)
    return newest.select(F.col("key").alias("id"), F.explode("payload").alias("p")).select("id", "p.*")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = shared_spans(_sequences(spark, sf), 40)
    return found.select(F.col("id").alias("is_id"), F.col("part").alias("seq_field"), F.col("no").alias("region_no"), "span_start", "span_end")


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    sequences = _sequences(spark, sf)
    shares = shared_shares(sequences, shared_spans(sequences, 40))
    return shares.select(F.col("id").alias("is_id"), "n_letters", "n_shared", F.round("share", 6).alias("share"))


# Problem 7


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_counts(table(spark, sf, "documents"), ["doc_id"], "text").withColumnRenamed("doc_id", "item_id")
    packed = pack_items(sizes, _limit(spark, sf, "container_capacity"))
    return packed.withColumnRenamed("item_id", "doc_id")


# Problem 8


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = token_counts(table(spark, sf, "documents"), ["source", "doc_id"], "text")
    targets = table(spark, sf, "mix_targets").withColumn("source", source_name("source"))
    return mix_sources(documents.withColumn("source", source_name("source")), targets)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


# Problem 9


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limit, overlap = _limit(spark, sf, "piece_limit"), _limit(spark, sf, "piece_overlap")
    return split_texts(table(spark, sf, "documents"), "doc_id", "text", limit, overlap)


QUERIES = {
    "p1_found": p1_found,
    "p1_ranked": p1_ranked,
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p7_containers": p7_containers,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_pieces": p9_pieces,
}

_ID = "nullif(trim({0}, ' ' || chr(9)), '')"
_BEST = f"""WITH h AS (SELECT DISTINCT {_ID.format('query_id')} AS query_id, hit_id, bitscore, evalue FROM diamond_hits
  WHERE {_ID.format('query_id')} IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore)),
r AS (SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY bitscore DESC, evalue ASC NULLS LAST, hit_id) AS rank FROM h)
"""
_SPANS = f"""WITH cur AS (SELECT * FROM (SELECT *, {_ID.format('is_id')} AS key, row_number() OVER (PARTITION BY {_ID.format('is_id')} ORDER BY loaded_at DESC) AS rn
  FROM is_elements WHERE {_ID.format('is_id')} IS NOT NULL) WHERE rn = 1),
seqs AS (SELECT key AS is_id, 'flanking_upstream' AS seq_field, 0 AS region_no, upper(flanking_upstream.sequence) AS s FROM cur
  UNION ALL SELECT key, 'noncoding_regions', n, upper(x.sequence) FROM (SELECT key, unnest(orf_annotation.noncoding_regions) AS x, generate_subscripts(orf_annotation.noncoding_regions, 1) - 1 AS n FROM cur)),
w AS (SELECT *, substr(s, p::INT + 1, 40) AS k FROM (SELECT *, unnest(range(length(s) - 39)) AS p FROM seqs WHERE length(s) >= 40)),
c AS (SELECT * FROM w WHERE NOT regexp_matches(k, '[^ACGT]')),
k AS (SELECT k FROM c GROUP BY k HAVING min(is_id) <> max(is_id)),
m AS (SELECT is_id, seq_field, region_no, p FROM c SEMI JOIN k USING (k)),
l AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY is_id, seq_field, region_no ORDER BY p) + 40 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT *, sum(new) OVER (PARTITION BY is_id, seq_field, region_no ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM l),
spans AS (SELECT is_id, seq_field, region_no::INT AS region_no, min(p)::INT AS span_start, (max(p) + 40)::INT AS span_end FROM g GROUP BY is_id, seq_field, region_no, g)
"""

ORACLES = {
    "p1_found": _BEST + "SELECT query_id, hit_id FROM r WHERE rank <= 5",
    "p1_ranked": _BEST + "SELECT query_id, hit_id, rank::INT AS rank FROM r WHERE rank <= 5",
    "p6_found": _SPANS + "SELECT * FROM spans",
    "p6_shares": _SPANS
    + """SELECT is_id, n::BIGINT AS n_letters, coalesce(m, 0)::BIGINT AS n_shared, round(CASE WHEN n > 0 THEN coalesce(m, 0) / n END, 6) AS share
FROM (SELECT is_id, sum(coalesce(length(s), 0)) AS n FROM seqs GROUP BY is_id) LEFT JOIN (SELECT is_id, sum(span_end - span_start) AS m FROM spans GROUP BY is_id) USING (is_id)""",
}
