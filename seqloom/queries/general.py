"""Queries of the numbered problems 2 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.common import clean_id, latest_version, table
from seqloom.operators.intervals import merge_intervals
from seqloom.operators.references import orphan_references, orphans_by_period
from seqloom.operators.shredding import child_places, node_rows, nodes
from seqloom.sources.raw_lines import parse_lines

CHILDREN = {
    "is_element": "is_element",
    "flanking_upstream": "flanking_upstream",
    "flanking_downstream": "flanking_downstream",
    "orf_annotation": "orf_annotation",
    "orf_annotation.noncoding_regions": "noncoding_regions",
    "orf_annotation.orfs": "orfs",
}
NESTED = ["is_element", "flanking_upstream", "flanking_downstream", "orf_annotation"]


# Problem 2


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "raw_lines"), "raw_id", "line_format", "line_text", "file_basename", "line_no")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where("outcome = 'error'").select(F.col("line_id").alias("raw_id"))


def p2_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where("outcome = 'error'").select(
        F.col("line_id").alias("raw_id"), "line_format", "reason", "error_line", "error_column", "line_text"
    )


def p2_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parsed(spark, sf).where("outcome = 'record' and line_format = 'm8'")
    return rows.select(F.col("line_id").alias("raw_id"), "hit.*")


def p2_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parsed(spark, sf).where("outcome = 'record' and line_format = 'gff'")
    return rows.select(F.col("line_id").alias("raw_id"), "feature.*").withColumn("n_attributes", F.size("attributes")).drop("attributes")


def p2_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parsed(spark, sf).where("outcome = 'record' and line_format = 'gff'")
    rows = rows.select(F.col("line_id").alias("raw_id"), F.posexplode("feature.attributes").alias("place", "a"))
    return rows.select("raw_id", "place", "a.key", "a.value")


# Problem 3


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "is_elements")
    schema = T.StructType([rows.schema[c] for c in NESTED])
    newest = latest_version(rows, clean_id("is_id"), F.col("loaded_at"), child_places(schema, CHILDREN))
    return newest.select(F.col("key").alias("is_id"), F.explode("payload").alias("c")).select("is_id", "c.*")


def _shredded(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "is_elements")
        schema = T.StructType([rows.schema[c] for c in NESTED])
        node = next(n for n in nodes(schema) if n.name == name)
        # Shredded before the newest row is chosen, so that only this object's leaves move.
        newest = latest_version(rows, clean_id("is_id"), F.col("loaded_at"), node_rows(schema, node))
        flat = newest.select(F.col("key").alias("record_key"), F.explode("payload").alias("x")).select("record_key", "x.*")
        return flat.withColumnRenamed("is_id", "own_is_id").withColumnRenamed("record_key", "is_id").drop("places")

    return query


# Problem 4


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = [
        table(spark, sf, name).select(
            F.lit(name).alias("ref_table"), F.col("hit_id").alias("ref_id"), clean_id("protein_id").alias("key"), F.col("loaded_at").alias("at")
        )
        for name in ("diamond_hits", "hmm_hits")
    ]
    parents = table(spark, sf, "proteins").select(
        clean_id("protein_id").alias("key"), F.col("loaded_at").alias("valid_from"), F.col("removed_at").alias("valid_to")
    )
    return orphan_references(refs[0].unionByName(refs[1]), parents)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", F.col("ref_id").alias("hit_id"))


def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", F.col("ref_id").alias("hit_id"), "reason")


def p4_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, sf)).select(
        "ref_table", F.date_format("period", "yyyy-MM").alias("month"), "reason", "n_orphans"
    )


# Problem 5


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gff_features").select(clean_id("seqid").alias("seqid"), "start", "end").where("start >= 1")
    return merge_intervals(rows, ["seqid"], "start", "end")


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("span_end") - F.col("span_start") + 1
    period = F.col("span_kind") == "period"
    return p5_found(spark, sf).groupBy("seqid").agg(
        F.count_if(period).alias("n_periods"),
        F.count_if(~period).alias("n_gaps"),
        F.sum(F.when(period, size)).alias("covered"),
        F.coalesce(F.sum(F.when(~period, size)), F.lit(0)).alias("uncovered"),
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_errors": p2_errors,
    "p2_hits": p2_hits,
    "p2_features": p2_features,
    "p2_attributes": p2_attributes,
    "p3_found": p3_found,
    "p3_elements": _shredded("is_element"),
    "p3_upstream": _shredded("flanking_upstream"),
    "p3_downstream": _shredded("flanking_downstream"),
    "p3_annotations": _shredded("orf_annotation"),
    "p3_noncoding_regions": _shredded("orf_annotation.noncoding_regions"),
    "p3_orfs": _shredded("orf_annotation.orfs"),
    "p4_found": p4_found,
    "p4_reasons": p4_reasons,
    "p4_by_month": p4_by_month,
    "p5_found": p5_found,
    "p5_coverage": p5_coverage,
}

# The same rows in SQL.

_ID = "nullif(trim({0}, ' ' || chr(9)), '')"
_CURRENT = f"""cur AS (SELECT * FROM (SELECT *, {_ID.format('is_id')} AS key, row_number() OVER (PARTITION BY {_ID.format('is_id')} ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM is_elements WHERE {_ID.format('is_id')} IS NOT NULL) WHERE rn = 1)"""


def _slots(array: str) -> str:
    return f"SELECT key, unnest({array}) AS x, generate_subscripts({array}, 1) - 1 AS n FROM cur"


def _flat(what: str, fields: str) -> str:
    return f"WITH {_CURRENT} SELECT key AS is_id, 0 AS child_no, {', '.join(f'{what}.{f}' if ' AS ' not in f else f'{what}.{f}' for f in fields.split(', '))} FROM cur WHERE {what} IS NOT NULL"


def _inner(array: str, fields: str) -> str:
    return f"WITH {_CURRENT}, s AS ({_slots(array)}) SELECT key AS is_id, n::INT AS child_no, {', '.join(f'x.{f}' for f in fields.split(', '))} FROM s WHERE x IS NOT NULL"


_M8 = r"""^([^"\s][^\t\s]*|"([^"\s]|"")+")\t([^"\t][^\t]*|"([^"]|"")+")\t([0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|-0+(\.0+)?([eE][+-]?[0-9]+)?|"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")(\t([0-9]+|"[0-9]+")){7}(\t([0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|-0+(\.0+)?([eE][+-]?[0-9]+)?|"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")){2}$"""
_SHARE = r"""^([^"\t]*|"([^"]|"")*")\t([^"\t][^\t]*|"([^"]|"")*")\t"?(-?[0-9.eE+-]+)"""
_GFF = r"""^[^\t]+\t[^\t]+\t[^\t]+\t[0-9]+\t[0-9]+\t(\.|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)\t[+.?-]\t[012.]\t(\.|(( *|ITEM);)*ITEM(;( *|ITEM))*)$""".replace(
    "ITEM", r"""( *[^\s="]+(=([^;"\s]|[^\S ]|"[^"]*"| +([^;"\s]|"[^"]*"))([^;"]|"[^"]*")*| +"[^"]*") *)"""
)

_P2_FOUND = f"""WITH l AS (SELECT raw_id, line_format, regexp_replace(line_text, '\\r$', '') AS t FROM raw_lines WHERE line_text IS NOT NULL),
c AS (SELECT * FROM l WHERE NOT starts_with(t, '#') AND regexp_matches(t, '\\S'))
SELECT raw_id FROM c WHERE NOT coalesce(CASE line_format
  WHEN 'm8' THEN regexp_matches(t, '{_M8}') AND try_cast(regexp_extract(t, '{_SHARE}', 5) AS DOUBLE) <= 100
  WHEN 'gff' THEN len(string_split(t, chr(9))) = 9 AND regexp_matches(t, '{_GFF}') AND try_cast(split_part(t, chr(9), 4) AS HUGEINT) >= 1
    AND try_cast(split_part(t, chr(9), 4) AS HUGEINT) <= try_cast(split_part(t, chr(9), 5) AS HUGEINT) END, false)"""

_P2_FEATURES = f"""WITH bad AS ({_P2_FOUND}), l AS (SELECT raw_id, regexp_replace(line_text, '\\r$', '') AS t FROM raw_lines WHERE line_format = 'gff' AND line_text IS NOT NULL),
c AS (SELECT raw_id, string_split(t, chr(9)) AS f FROM l WHERE NOT starts_with(t, '#') AND regexp_matches(t, '\\S') AND raw_id NOT IN (SELECT raw_id FROM bad)),
i AS (SELECT *, CASE WHEN f[9] = '.' THEN [] ELSE list_filter(list_transform(regexp_extract_all(f[9], '(?:[^;"]|"[^"]*")+'), lambda x: trim(x, ' ')), lambda x: x <> '') END AS items FROM c)
"""

_P4 = f"""WITH refs AS (SELECT 'diamond_hits' AS ref_table, hit_id, {_ID.format('protein_id')} AS key, loaded_at AS seen FROM diamond_hits
  UNION SELECT 'hmm_hits', hit_id, {_ID.format('protein_id')}, loaded_at FROM hmm_hits),
p AS (SELECT DISTINCT {_ID.format('protein_id')} AS key, loaded_at AS f, removed_at AS t FROM proteins),
o AS (SELECT r.ref_table, r.hit_id, r.seen, count(p.key) AS n, count(CASE WHEN p.f <= r.seen THEN 1 END) AS begun,
    count(CASE WHEN p.f <= r.seen AND (p.t IS NULL OR p.t > r.seen) THEN 1 END) AS alive
  FROM refs r LEFT JOIN p ON p.key = r.key WHERE r.key IS NOT NULL GROUP BY ALL),
orphans AS (SELECT ref_table, hit_id, seen, CASE WHEN n = 0 THEN 'missing' WHEN seen IS NULL THEN 'undated' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS reason FROM o WHERE alive = 0)
"""

_P5 = f"""WITH f AS (SELECT DISTINCT {_ID.format('seqid')} AS seqid, start AS s, "end" AS e FROM gff_features WHERE {_ID.format('seqid')} IS NOT NULL AND start >= 1 AND start <= "end"),
r AS (SELECT *, max(e) OVER (PARTITION BY seqid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r),
p AS (SELECT seqid, min(s) AS s, max(e) AS e FROM g GROUP BY seqid, g),
n AS (SELECT *, lead(s) OVER (PARTITION BY seqid ORDER BY s) AS after FROM p),
spans AS (SELECT seqid, 'period' AS span_kind, s AS span_start, e AS span_end FROM p UNION ALL SELECT seqid, 'gap', e + 1, after - 1 FROM n WHERE after IS NOT NULL)
"""

ORACLES = {
    "p2_found": _P2_FOUND,
    "p3_found": f"""WITH {_CURRENT}, nc AS ({_slots('orf_annotation.noncoding_regions')}), orf AS ({_slots('orf_annotation.orfs')})
SELECT key AS is_id, 'is_element' AS child_kind, 0::INT AS child_no FROM cur WHERE is_element IS NOT NULL
UNION ALL SELECT key, 'flanking_upstream', 0 FROM cur WHERE flanking_upstream IS NOT NULL
UNION ALL SELECT key, 'flanking_downstream', 0 FROM cur WHERE flanking_downstream IS NOT NULL
UNION ALL SELECT key, 'orf_annotation', 0 FROM cur WHERE orf_annotation IS NOT NULL
UNION ALL SELECT key, 'noncoding_regions', n FROM nc WHERE x IS NOT NULL
UNION ALL SELECT key, 'orfs', n FROM orf WHERE x IS NOT NULL""",
    "p3_elements": _flat("is_element", "sequence, length, contig, start, end, strand"),
    "p3_upstream": _flat("flanking_upstream", "sequence, length, contig_start, contig_end"),
    "p3_downstream": _flat("flanking_downstream", "sequence, length, contig_start, contig_end"),
    "p3_annotations": _flat("orf_annotation", "is_id AS own_is_id, is_length, num_orfs, num_noncoding_regions"),
    "p3_noncoding_regions": _inner("orf_annotation.noncoding_regions", "start, end, length, type, sequence"),
    "p3_orfs": _inner("orf_annotation.orfs", "orf_id, start, end, strand, length_aa, protein_sequence"),
    "p4_found": _P4 + "SELECT ref_table, hit_id FROM orphans",
    "p4_reasons": _P4 + "SELECT ref_table, hit_id, reason FROM orphans",
    "p4_by_month": _P4 + "SELECT ref_table, strftime(seen, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM orphans GROUP BY ALL",
    "p5_found": _P5 + "SELECT * FROM spans",
    "p5_coverage": _P5
    + """SELECT seqid, count(*) FILTER (span_kind = 'period') AS n_periods, count(*) FILTER (span_kind = 'gap') AS n_gaps,
  (sum(span_end - span_start + 1) FILTER (span_kind = 'period'))::BIGINT AS covered, coalesce(sum(span_end - span_start + 1) FILTER (span_kind = 'gap'), 0)::BIGINT AS uncovered FROM spans GROUP BY seqid""",
    "p2_hits": f"""WITH bad AS ({_P2_FOUND}), l AS (SELECT raw_id, regexp_replace(line_text, '\\r$', '') AS t FROM raw_lines WHERE line_format = 'm8' AND line_text IS NOT NULL),
c AS (SELECT * FROM l WHERE NOT starts_with(t, '#') AND regexp_matches(t, '\\S') AND raw_id NOT IN (SELECT raw_id FROM bad)),
f AS (SELECT raw_id, list_transform(regexp_extract_all(t, '(?:^|\\t)("(?:[^"]|"")*"|[^\\t]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS a FROM c)
SELECT raw_id, a[1] AS query_id, a[2] AS subject_id, a[3]::DOUBLE AS pident, a[4]::BIGINT AS alignment_length, a[5]::BIGINT AS mismatches, a[6]::BIGINT AS gap_opens, a[7]::BIGINT AS query_start,
  a[8]::BIGINT AS query_end, a[9]::BIGINT AS subject_start, a[10]::BIGINT AS subject_end, a[11]::DOUBLE AS evalue, a[12]::DOUBLE AS bitscore FROM f""",
    "p2_features": _P2_FEATURES
    + """SELECT raw_id, f[1] AS seqid, f[2] AS source, f[3] AS feature_type, f[4]::BIGINT AS start, f[5]::BIGINT AS "end", CASE WHEN f[6] <> '.' THEN f[6]::DOUBLE END AS score, f[7] AS strand,
  CASE WHEN f[8] <> '.' THEN f[8]::INT END AS phase, len(items)::INT AS n_attributes FROM i""",
    "p2_attributes": _P2_FEATURES
    + r"""SELECT raw_id, place, regexp_extract(x, '^([^\s="]+)', 1) AS key, CASE WHEN regexp_matches(x, '^[^\s="]+=') THEN regexp_extract(x, '^[^\s="]+=(.*)$', 1) ELSE regexp_extract(x, '"([^"]*)"$', 1) END AS value
FROM (SELECT raw_id, unnest(items) AS x, (generate_subscripts(items, 1) - 1)::INT AS place FROM i)""",
}
