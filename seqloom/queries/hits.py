"""Queries over search hits, gene positions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import clean_id, table
from seqloom.functions import sequence as S
from seqloom.functions import statistics as X
from seqloom.operators import analytics as A
from seqloom.operators import positions as P
from seqloom.operators.locate import locate_hits, unlocated
from seqloom.operators.search import fasta_header
from seqloom.plans.workflows import hit_summary
from seqloom.sources import formats
from seqloom.sources.sinks import PROFILE_HIT_COLUMNS, PROTEIN_HIT_COLUMNS, hit_table


def _hits(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """``hit_id`` and the given columns of protein hits: exact copies once, ids cleaned, a score that is not a number as null.

    A hit's copies are equal in all columns, so only the wanted ones are read and compared.
    """
    rows = table(spark, sf, "diamond_hits").select(
        "hit_id", *[clean_id(c).alias(c) if c in _IDS else F.nanvl(c, F.lit(None)).alias(c) if c == "bitscore" else F.col(c) for c in columns]
    )
    return rows.distinct()


def _profiles(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """As ``_hits``, of profile hits."""
    return table(spark, sf, "hmm_hits").select("hit_id", *[clean_id(c).alias(c) if c in _IDS else F.col(c) for c in columns]).distinct()


#: Columns of a hit's place.
PLACE = ("contig_id", "start", "end", "strand")
_IDS = ("query_id", "target_name", "protein_id", "contig_id")


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return P.current_positions(table(spark, sf, "proteins"))


def _located(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return locate_hits(_hits(spark, sf, "query_id", *columns), _positions(spark, sf), "query_id")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).select("protein_id", "start", "end", "strand", "contig_id", (F.abs(F.col("end") - F.col("start")) + 1).alias("length"))


def contig_names(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).select(
        "protein_id", S.contig_of("protein_id").alias("any_part"), S.contig_of("protein_id", when_numeric=True).alias("number_part"),
        S.contig_or_empty("protein_id").alias("or_empty"), S.target_key("protein_id").alias("target"), S.short_orf_id("protein_id").alias("short"),
    )


def contig_gene_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).groupBy("contig_id").agg(
        F.count("*").alias("n_genes"), F.min("start").alias("first"), F.max("end").alias("last"), F.count_if(F.col("strand") == 1).alias("n_forward")
    )


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.index_stats(_positions(spark, sf))


def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "hmm_hits").select(clean_id("target_name").alias("target_name")).where("target_name is not null").select(F.col("target_name").alias("protein_id")).distinct()
    return P.get_positions(_positions(spark, sf), ids).select("protein_id", "start", "end", "strand", "contig_id")


def index_contains(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "diamond_hits").select(clean_id("query_id").alias("query_id")).where("query_id is not null").select(F.col("query_id").alias("protein_id")).distinct()
    return P.contains(_positions(spark, sf), ids)


def located_protein_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf, "bitscore").select("hit_id", "protein_id", "start", "end", "strand", "contig_id", "length", "is_forward", "bitscore")


def located_profile_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = locate_hits(_profiles(spark, sf, "target_name", "domain_number", "domain_score"), _positions(spark, sf), "target_name")
    return found.select("hit_id", "protein_id", "start", "end", "strand", "contig_id", "length", "is_forward", "domain_number", "domain_score")


def unlocated_protein_hits(spark: SparkSession, sf: str) -> DataFrame:
    return unlocated(_hits(spark, sf, "query_id"), _positions(spark, sf), "query_id").select("hit_id", "query_id")


def protein_hit_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hits(spark, sf, *[c for c in table(spark, sf, "diamond_hits").columns if c in PROTEIN_HIT_COLUMNS])
    return hit_table(rows, PROTEIN_HIT_COLUMNS)


def profile_hit_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = _profiles(spark, sf, *[c for c in table(spark, sf, "hmm_hits").columns if c in PROFILE_HIT_COLUMNS])
    return hit_table(rows, PROFILE_HIT_COLUMNS)


def subject_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = hit_summary(_located(spark, sf, "subject_id", "pident", "evalue", "bitscore"))
    return found.withColumns({"mean_pident": F.round("mean_pident", 6)})


def subject_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = A.group_stats(_hits(spark, sf, "subject_id", "pident"), ["subject_id"], "pident")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def subjects_having(spark: SparkSession, sf: str) -> DataFrame:
    return A.groups_having(_hits(spark, sf, "subject_id", "pident"), ["subject_id"], "pident", 60.0, 3).select("subject_id", "n")


def hit_description(spark: SparkSession, sf: str) -> DataFrame:
    names = ["pident", "alignment_length", "mismatches", "gap_opens"]
    found = A.describe(_hits(spark, sf, *names), names)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


def hit_correlations(spark: SparkSession, sf: str) -> DataFrame:
    names = ["pident", "alignment_length", "mismatches"]
    return A.correlations(_hits(spark, sf, *names), names).withColumn("r", F.round("r", 6))


def best_profile_per_protein(spark: SparkSession, sf: str) -> DataFrame:
    rows = _profiles(spark, sf, "protein_id", "query_name", "evalue").where("protein_id is not null")
    best = A.best_per_group(rows, ["protein_id"], [F.asc_nulls_last("evalue"), F.col("hit_id")], 1)
    return best.select("protein_id", "hit_id", "query_name", "evalue")


def best_profiles_per_family(spark: SparkSession, sf: str) -> DataFrame:
    best = A.best_per_group(_profiles(spark, sf, "query_name", "evalue"), ["query_name"], [F.asc_nulls_last("evalue"), F.col("hit_id")], 5)
    return best.select("query_name", "hit_id", "rank")


def hit_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = A.with_hit_columns(_hits(spark, sf, *PLACE, "pident", "evalue"))
    return found.select("hit_id", "length", "is_forward", F.round("neg_log_evalue", 6).alias("neg_log_evalue"), "identity_bin", "length_class", "location")


def length_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.count_table(A.with_hit_columns(_hits(spark, sf, "file_basename", *PLACE, "pident", "evalue")), "file_basename", "length_class", ["short", "medium", "long"])


def subjects_on_both_strands(spark: SparkSession, sf: str) -> DataFrame:
    return A.present_in_all(table(spark, sf, "diamond_hits"), "subject_id", "strand")


def identity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(_hits(spark, sf, "pident"), "pident", 0.0, 100.0, 20)


def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(_hits(spark, sf, "file_basename"), "file_basename")


def transposase_hits(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("subject_id").ilike("%transposase%") | F.col("subject_id").contains("tnp")
    good = text & F.col("pident").between(40, 90) & (F.abs(F.col("end") - F.col("start")) + 1 >= 300) & F.col("evalue").isNotNull()
    return table(spark, sf, "diamond_hits").where(good).select("hit_id", "subject_id", "pident").distinct()


def hit_evalues(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("alignment_length"), F.least("mismatches", F.col("alignment_length"))
    space = F.greatest(F.lit(1), F.col("query_end") - F.col("query_start") + 2) * F.greatest(F.lit(1), F.col("subject_end") - F.col("subject_start") + 2)
    score = (n - k) * 2 - k - F.col("gap_opens") * 3
    e, g = X.ungapped_evalue(n, k, space), X.gapped_evalue(score, n, n + 10)
    names = ("alignment_length", "mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end")
    rows = _hits(spark, sf, *names).where("alignment_length > 0 and mismatches is not null and gap_opens is not null").where(space.isNotNull())
    return rows.select(
        "hit_id", F.round(F.log10(F.when((e > 0) & (e < 1e300), e)), 5).alias("log_e"), F.round(F.log10(F.when((g > 0) & (g < 1e300), g)), 5).alias("log_gapped"),
        F.round(X.evalue_to_pvalue(g), 6).alias("p_gapped"),
    )


def hit_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hits(spark, sf, "query_id", "pident", "evalue", "bitscore")
    header = fasta_header(F.col("query_id"), identity=F.col("pident") / 100, evalue=F.col("evalue"), score=F.col("bitscore"))
    return rows.where("query_id is not null and pident is not null and evalue is not null and bitscore is not null").select("hit_id", header.alias("header"))


# The formats' lines made from the tables and parsed again


def parsed_search_lines(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for n, _ in formats.SEARCH_FIELDS]
    rows = _hits(spark, sf, *names).na.drop()
    lines = rows.select("hit_id", F.concat_ws("\t", *[F.col(n).cast("string") for n in names]).alias("value"))
    return formats.parse_hits(lines)


def parsed_profile_lines(spark: SparkSession, sf: str) -> DataFrame:
    names = ("target_name", "accession", "query_name", "evalue", "score", "bias", "domain_number", "domain_evalue", "domain_score")
    rows = _profiles(spark, sf, *names).where("target_name is not null and evalue is not null and score is not null and bias is not null and accession is not null and query_name is not null")
    x = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    dash = F.lit("-")
    value = F.concat_ws(
        " ", "target_name", "accession", dash, F.regexp_replace("query_name", r"\s", "_"), dash, dash, x("evalue"), x("score"), x("bias"), x("domain_number"),
        dash, dash, x("domain_evalue"), dash, x("domain_score"), dash, dash, dash, dash,
    )
    found = formats.parse_profile_hits(rows.select("hit_id", value.alias("value")))
    return found.select("hit_id", "target_name", "query_name", "evalue", "score", "bias", "domain_number", "domain_evalue", "domain_score")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gff_features")
    return rows.where("seqid is not null and start is not null and end is not null").dropDuplicates(["feature_id"])


def parsed_feature_lines(spark: SparkSession, sf: str) -> DataFrame:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    items = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    value = F.concat_ws("\t", clean_id("seqid"), dot("source"), dot("feature_type"), F.col("start"), F.col("end"), dot("score"), dot("strand"), dot("phase"), F.coalesce(items, F.lit("")))
    found = formats.parse_features(_features(spark, sf).where(clean_id("seqid").isNotNull()).select("feature_id", value.alias("value")))
    return found.select("feature_id", "seqid", "feature_type", "start", "end", "score", "phase", F.col("attributes")["ID"].alias("id"))


def parsed_bed_lines(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat_ws("\t", clean_id("seqid"), F.col("start") - 1, F.col("end"), F.coalesce("feature_type", F.lit("x")), F.lit("."), F.coalesce("strand", F.lit(".")))
    found = formats.parse_bed(_features(spark, sf).where(clean_id("seqid").isNotNull()).select("feature_id", value.alias("value")))
    return found.select("feature_id", "chrom", "start", "end", "name", "score", "strand", (F.col("end") - F.col("start")).alias("length"))


def parsed_gene_headers(spark: SparkSession, sf: str) -> DataFrame:
    header = F.concat_ws(" # ", "protein_id", F.col("start"), F.col("end"), F.col("strand"), F.lit("ID=1_1"))
    return _positions(spark, sf).where("start is not null and end is not null and strand is not null").select(*formats.gene_fields(header))


def feature_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf).select(clean_id("seqid").alias("seqid"), "feature_type", "start", "end", "strand", "attributes", F.lit("").alias("file_path"), F.col("feature_id").alias("record_rank"))
    return P.positions_from_features(rows.where("seqid is not null"))


def all_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Protein and profile hits under common names, as a bag; a score that is not a number is null."""
    a = table(spark, sf, "diamond_hits").select(F.lit("protein").alias("kind"), "hit_id", clean_id("protein_id").alias("protein_id"), "evalue", F.nanvl("bitscore", F.lit(None)).alias("score"))
    b = table(spark, sf, "hmm_hits").select(F.lit("profile").alias("kind"), "hit_id", clean_id("protein_id").alias("protein_id"), "evalue", "score")
    return a.unionByName(b)


def proteins_in_both(spark: SparkSession, sf: str) -> DataFrame:
    rows = all_hits(spark, sf).where("protein_id is not null")
    return rows.where("kind = 'protein'").select("protein_id").intersect(rows.where("kind = 'profile'").select("protein_id"))


def repeated_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that are there more than once, and how often."""
    return table(spark, sf, "diamond_hits").groupBy("hit_id").agg(F.count("*").alias("n")).where("n > 1")


def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ["query_id", "protein_id", "contig_id", "evalue", "bitscore", "loaded_at"]
    return table(spark, sf, "diamond_hits").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best hits of all, a report."""
    rows = _hits(spark, sf, "bitscore").where(F.col("bitscore").isNotNull())
    return rows.orderBy(F.desc("bitscore"), "hit_id").limit(10).select("hit_id", "bitscore")


QUERIES = {
    f.__name__: f
    for f in (
        positions, contig_names, contig_gene_counts, index_stats, index_lookup, index_contains, located_protein_hits, located_profile_hits,
        unlocated_protein_hits, protein_hit_table, profile_hit_table, subject_summary, subject_stats, subjects_having, hit_description,
        hit_correlations, best_profile_per_protein, best_profiles_per_family, hit_columns, length_class_counts, subjects_on_both_strands,
        identity_histogram, file_counts, transposase_hits, hit_evalues, hit_headers, parsed_search_lines, parsed_profile_lines,
        parsed_feature_lines, parsed_bed_lines, parsed_gene_headers, feature_positions, all_hits, proteins_in_both,
        repeated_hits, null_counts, top_scores,
    )
}

_C = "nullif(trim({0}, ' ' || chr(9)), '')"
_H = f"""h AS (SELECT DISTINCT * REPLACE ({_C.format('query_id')} AS query_id, {_C.format('protein_id')} AS protein_id, {_C.format('contig_id')} AS contig_id, CASE WHEN NOT isnan(bitscore) THEN bitscore END AS bitscore) FROM (SELECT DISTINCT * FROM diamond_hits))"""
_M = f"""m AS (SELECT DISTINCT * REPLACE ({_C.format('target_name')} AS target_name, {_C.format('protein_id')} AS protein_id, {_C.format('contig_id')} AS contig_id) FROM (SELECT DISTINCT * FROM hmm_hits))"""
_P = f"""p AS (SELECT * FROM (SELECT {_C.format('protein_id')} AS protein_id, start, "end", strand, {_C.format('contig_id')} AS contig_id, row_number() OVER (PARTITION BY {_C.format('protein_id')}
  ORDER BY loaded_at DESC NULLS LAST, start DESC NULLS LAST, "end" DESC NULLS LAST, strand DESC NULLS LAST, contig_id DESC NULLS LAST) AS rn FROM proteins) WHERE rn = 1 AND protein_id IS NOT NULL)"""
_G = f"""g AS (SELECT DISTINCT ON (feature_id) * REPLACE ({_C.format('seqid')} AS seqid) FROM gff_features WHERE {_C.format('seqid')} IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL)"""
_LEN = 'abs(h."end" - h.start) + 1'
_CLASS = f"CASE WHEN {_LEN} < 300 THEN 'short' WHEN {_LEN} < 1000 THEN 'medium' ELSE 'long' END"
_ON_P = 'p.protein_id, p.start, p."end", p.strand, {0} AS contig_id, abs(p."end" - p.start) + 1 AS length, p.strand = 1 AS is_forward'
_CHOOSE = "(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))"
_SPACE = "(greatest(1, query_end - query_start + 2) * greatest(1, subject_end - subject_start + 2))"

ORACLES = {
    "positions": f'WITH {_P} SELECT protein_id, start, "end", strand, contig_id, abs("end" - start) + 1 AS length FROM p',
    "contig_names": f"""WITH {_P} SELECT protein_id, regexp_replace(protein_id, '_[^_]*$', '') AS any_part, regexp_replace(protein_id, '_[0-9]+$', '') AS number_part,
  regexp_extract(protein_id, '^(.*)_[^_]*$', 1) AS or_empty, split_part(protein_id, '_', 1) AS target, split_part(protein_id, '_', -1) AS short FROM p""",
    "contig_gene_counts": f'WITH {_P} SELECT contig_id, count(*) AS n_genes, min(start) AS first, max("end") AS last, count(*) FILTER (strand = 1) AS n_forward FROM p GROUP BY contig_id',
    "index_stats": f"WITH {_P} SELECT count(*) AS n_proteins, count(DISTINCT contig_id) AS n_contigs FROM p",
    "index_lookup": f'WITH {_P}, {_M} SELECT protein_id, start, "end", strand, contig_id FROM p WHERE protein_id IN (SELECT target_name FROM m WHERE target_name IS NOT NULL)',
    "index_contains": f"WITH {_P}, {_H} SELECT DISTINCT query_id AS protein_id, query_id IN (SELECT protein_id FROM p) AS found FROM h WHERE query_id IS NOT NULL",
    "located_protein_hits": f"WITH {_P}, {_H} SELECT hit_id, {_ON_P.format(chr(39).join(['regexp_replace(p.protein_id, ', '_[^_]*$', ', ', '', ')']))}, bitscore FROM h JOIN p ON h.query_id = p.protein_id",
    "located_profile_hits": f"WITH {_P}, {_M} SELECT hit_id, {_ON_P.format(chr(39).join(['regexp_replace(p.protein_id, ', '_[^_]*$', ', ', '', ')']))}, domain_number, domain_score FROM m JOIN p ON m.target_name = p.protein_id",
    "unlocated_protein_hits": f"WITH {_P}, {_H} SELECT hit_id, query_id FROM h ANTI JOIN p ON h.query_id = p.protein_id",
    "protein_hit_table": f"""WITH {_H} SELECT file_basename, contig_id, protein_id, start, "end", strand, strand = 1 AS is_forward, {_LEN} AS length, query_id, subject_id, pident, alignment_length, mismatches, gap_opens,
  query_start, query_end, subject_start, subject_end, evalue, bitscore, NULL::VARCHAR AS genomic_sequence FROM h""",
    "profile_hit_table": f"""WITH {_M} SELECT file_basename, contig_id, protein_id, start, "end", strand, strand = 1 AS is_forward, {_LEN.replace('h.', 'm.')} AS length, query_name, target_name, evalue, score, bias,
  domain_number, domain_evalue, domain_score, NULL::VARCHAR AS genomic_sequence FROM m""",
    "subject_summary": f"""WITH {_P}, {_H} SELECT subject_id, count(*) AS n_hits, round(avg(pident), 6) AS mean_pident, min(evalue) AS best_evalue, max(bitscore) AS best_bitscore FROM h JOIN p ON h.query_id = p.protein_id
  WHERE evalue < 1e-5 AND pident > 30 AND p.strand = 1 GROUP BY subject_id""",
    "subject_stats": f"""WITH {_H} SELECT subject_id, count(*) AS n, round(avg(pident), 6) AS mean, min(pident) AS min, max(pident) AS max, round(stddev_samp(pident), 6) AS std, count(DISTINCT pident) AS n_distinct FROM h GROUP BY subject_id""",
    "subjects_having": f"WITH {_H} SELECT subject_id, count(*) AS n FROM h GROUP BY subject_id HAVING avg(pident) > 60 AND count(*) >= 3",
    "hit_description": f"WITH {_H} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM h"
        for c in ("pident", "alignment_length", "mismatches", "gap_opens")
    ),
    "hit_correlations": f"WITH {_H} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM h" for a, b in (("pident", "alignment_length"), ("pident", "mismatches"), ("alignment_length", "mismatches"))),
    "best_profile_per_protein": f"WITH {_M} SELECT protein_id, hit_id, query_name, evalue FROM m WHERE protein_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY evalue NULLS LAST, hit_id) = 1",
    "best_profiles_per_family": f"WITH {_M}, r AS (SELECT query_name, hit_id, row_number() OVER (PARTITION BY query_name ORDER BY evalue NULLS LAST, hit_id)::INT AS rank FROM m) SELECT * FROM r WHERE rank <= 5",
    "hit_columns": f"""WITH {_H} SELECT hit_id, {_LEN} AS length, strand = 1 AS is_forward, round(CASE WHEN evalue > 0 THEN -log10(evalue) WHEN evalue = 0 THEN -300 END, 6) AS neg_log_evalue,
  CASE WHEN pident > 0 AND pident <= 80 THEN 'low' WHEN pident > 80 AND pident <= 90 THEN 'medium' WHEN pident > 90 AND pident <= 95 THEN 'high' WHEN pident > 95 AND pident <= 100 THEN 'very_high' END AS identity_bin,
  {_CLASS} AS length_class, contig_id || ':' || start || '-' || "end" AS location FROM h""",
    "length_class_counts": f"""WITH {_H}, c AS (SELECT file_basename, {_CLASS} AS k FROM h) SELECT file_basename, count(*) FILTER (k = 'short') AS short, count(*) FILTER (k = 'medium') AS medium, count(*) FILTER (k = 'long') AS long FROM c GROUP BY file_basename""",
    "subjects_on_both_strands": f"WITH {_H}, q AS (SELECT DISTINCT subject_id, strand FROM h WHERE subject_id IS NOT NULL AND strand IS NOT NULL) SELECT subject_id, count(*) AS n_groups FROM q GROUP BY subject_id HAVING count(*) = (SELECT count(DISTINCT strand) FROM q)",
    "identity_histogram": f"WITH {_H}, b AS (SELECT least(floor(pident / 5), 19)::INT AS bin FROM h WHERE pident BETWEEN 0 AND 100 AND NOT isnan(pident)) SELECT bin, count(*) AS n, bin * 5.0::DOUBLE AS low_edge FROM b GROUP BY bin",
    "file_counts": f"WITH {_H} SELECT file_basename, count(*) AS n FROM h GROUP BY file_basename",
    "transposase_hits": f"""WITH {_H} SELECT hit_id, subject_id, pident FROM h WHERE (subject_id ILIKE '%transposase%' OR contains(subject_id, 'tnp')) AND pident BETWEEN 40 AND 90 AND {_LEN} >= 300 AND evalue IS NOT NULL""",
    "hit_evalues": f"""WITH {_H}, x AS (SELECT hit_id, alignment_length AS n, least(mismatches, alignment_length) AS k, {_SPACE} AS space, gap_opens FROM h WHERE alignment_length > 0 AND mismatches IS NOT NULL AND gap_opens IS NOT NULL AND {_SPACE} IS NOT NULL),
y AS (SELECT *, exp(ln(space) + {_CHOOSE} + k * ln(3) - n * ln(4)) AS e, (n - k) * 2 - k - gap_opens * 3 AS s FROM x),
z AS (SELECT *, CASE WHEN s <= 0 THEN 'Infinity'::DOUBLE ELSE exp(ln(0.1) + ln(n) + ln(n + 10) - s * ln((sqrt(13) - 1) / 2)) END AS g FROM y)
SELECT hit_id, round(CASE WHEN e > 0 AND e < 1e300 THEN log10(e) END, 5) AS log_e, round(CASE WHEN g > 0 AND g < 1e300 THEN log10(g) END, 5) AS log_gapped, round(CASE WHEN g >= 700 THEN 1 ELSE 1 - exp(-g) END, 6) AS p_gapped FROM z""",
    # Java's format rounds half up.
    "hit_headers": f"""WITH {_H} SELECT hit_id, printf('>%s identity=%.2f evalue=%.2e score=%.1f', query_id, ((round(pident * 10)::BIGINT + 5) // 10) / 100, evalue, bitscore) AS header FROM h
  WHERE query_id IS NOT NULL AND pident IS NOT NULL AND evalue IS NOT NULL AND bitscore IS NOT NULL""",
    "parsed_search_lines": f"""WITH {_H} SELECT hit_id, query_id, subject_id, pident, alignment_length, mismatches, gap_opens, query_start, query_end, subject_start, subject_end, evalue, bitscore FROM h
  WHERE COLUMNS([{', '.join(repr(n) for n, _ in formats.SEARCH_FIELDS)}]) IS NOT NULL""",
    "parsed_profile_lines": f"""WITH {_M} SELECT hit_id, target_name, regexp_replace(query_name, '\\s', '_', 'g') AS query_name, evalue, score, bias, domain_number, CASE WHEN domain_number IS NOT NULL THEN domain_evalue END AS domain_evalue,
  CASE WHEN domain_number IS NOT NULL AND domain_evalue IS NOT NULL THEN domain_score END AS domain_score FROM m WHERE target_name IS NOT NULL AND evalue IS NOT NULL AND score IS NOT NULL AND bias IS NOT NULL AND accession IS NOT NULL AND query_name IS NOT NULL""",
    "parsed_feature_lines": f"""WITH {_G} SELECT feature_id, seqid, coalesce(feature_type, '.') AS feature_type, start, "end", score, phase, trim(attributes['ID']) AS id FROM g""",
    "parsed_bed_lines": f"""WITH {_G} SELECT feature_id, seqid AS chrom, start - 1 AS start, "end", coalesce(feature_type, 'x') AS name, NULL::INT AS score, coalesce(strand, '.') AS strand, "end" - start + 1 AS length FROM g""",
    "parsed_gene_headers": f'WITH {_P} SELECT protein_id, start, "end", strand FROM p WHERE start IS NOT NULL AND "end" IS NOT NULL AND strand IS NOT NULL',
    "feature_positions": f"""WITH {_G} SELECT seqid || '_' || split_part(attributes['ID'], '_', -1) AS protein_id, arg_min(start, feature_id) AS start, arg_min("end", feature_id) AS "end",
  arg_min(CASE WHEN strand = '+' THEN 1 ELSE -1 END, feature_id)::TINYINT AS strand, arg_min(seqid, feature_id) AS contig_id FROM g WHERE feature_type = 'CDS' AND coalesce(attributes['ID'], '') <> '' GROUP BY 1""",
    "all_hits": f"""SELECT 'protein' AS kind, hit_id, {_C.format('protein_id')} AS protein_id, evalue, CASE WHEN NOT isnan(bitscore) THEN bitscore END AS score FROM diamond_hits
  UNION ALL SELECT 'profile', hit_id, {_C.format('protein_id')}, evalue, score FROM hmm_hits""",
    "proteins_in_both": f"""SELECT {_C.format('protein_id')} AS protein_id FROM diamond_hits WHERE {_C.format('protein_id')} IS NOT NULL INTERSECT SELECT {_C.format('protein_id')} FROM hmm_hits""",
    "repeated_hits": "SELECT hit_id, count(*) AS n FROM diamond_hits GROUP BY hit_id HAVING count(*) > 1",
    "null_counts": "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("query_id", "protein_id", "contig_id", "evalue", "bitscore", "loaded_at")) + " FROM diamond_hits",
    "top_scores": f"WITH {_H} SELECT hit_id, bitscore FROM h WHERE bitscore IS NOT NULL ORDER BY bitscore DESC, hit_id LIMIT 10",
}
