"""Queries over element records: sequence metrics, regions, alignments, verdicts, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import table
from seqloom.functions import sequence as S
from seqloom.operators import filters as P
from seqloom.operators.alignments import Finder, find_between, find_within
from seqloom.operators.analytics import describe, with_alignment_columns
from seqloom.operators.elements import alignment_parts, element_alignments, element_pairs, filter_inputs, newest_elements, process_elements
from seqloom.operators.gapped import extend_with_gaps
from seqloom.operators.locate import retrieval_counts, with_genomic_sequence, with_target_sequence
from seqloom.operators.regions import extract_regions
from seqloom.operators.search import deduplicate_hits
from seqloom.operators.segments import search_segments, search_words
from seqloom.plans.workflows import candidates_by_element, guide_candidates
from seqloom.sources.sinks import arc_features, deduplicated_alignments, element_features, flat_file


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return newest_elements(table(spark, sf, "is_elements"))


def _aligned_elements(spark: SparkSession, sf: str) -> DataFrame:
    return newest_elements(table(spark, sf, "is_elements"), alignment_parts())


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.struct("orf_annotation.noncoding_regions").alias("orf_annotation")]
    rows = newest_elements(table(spark, sf, "is_elements"), parts).select("is_id", F.posexplode("orf_annotation.noncoding_regions").alias("region_no", "r"))
    return rows.where("r.sequence is not null").select("is_id", "region_no", F.col("r.sequence").alias("seq"))


def sequence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select(
        "is_id", "region_no", S.reverse_complement("seq").alias("turned"), F.round(S.at_content("seq"), 6).alias("at"),
        F.round(S.gc_content("seq"), 6).alias("gc"), F.round(S.shannon_entropy("seq"), 6).alias("entropy"),
        S.longest_homopolymer("seq").alias("run"), S.has_homopolymer("seq").alias("has_run"), F.round(S.dinucleotide_ratio("seq"), 6).alias("dinucleotide"),
        S.has_dinucleotide_repeat("seq", 0.2).alias("has_repeat"),
    )


def flank_identity(spark: SparkSession, sf: str) -> DataFrame:
    up, down = F.col("flanking_upstream.sequence"), F.col("flanking_downstream.sequence")
    rows = _elements(spark, sf).where(up.isNotNull() & down.isNotNull())
    n = F.least(F.length(up), F.length(down))
    a, b = F.upper(F.substring(up, F.lit(1), n)), F.upper(F.substring(down, F.lit(1), n))
    return rows.select(
        "is_id", F.round(S.sequence_identity(up, down), 6).alias("identity"), S.mismatches(a, b).alias("mismatches"),
        F.length(F.replace(S.marker_line(a, b), F.lit("."), F.lit(""))).alias("matches"), F.right(up, F.lit(50)).alias("inner_up"), F.left(down, F.lit(50)).alias("inner_down"),
    )


def orf_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _elements(spark, sf)
    genes = rows.select(F.col("is_id").alias("contig_id"), F.posexplode("orf_annotation.orfs").alias("orf_no", "o")).where("o is not null")
    genes = genes.select("contig_id", "orf_no", "o.start", "o.end", S.strand_number("o.strand").alias("strand"))
    contigs = rows.select(F.col("is_id").alias("contig_id"), F.col("is_element.sequence").alias("sequence"))
    found = extract_regions(genes, contigs, 35, 25)
    parts = [F.col(p)[f].alias(f"{p}_{f}") for p in ("coding", "upstream", "downstream") for f in ("start", "end", "length", "sequence")]
    return found.select("contig_id", "orf_no", "problem", *parts)


def _probes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _elements(spark, sf).where("is_element.length is not null")
    start = F.pmod(F.col("is_element.length"), F.lit(1500)) + 1
    probes = rows.select(
        "is_id", F.substring("is_id", 1, 10).alias("contig_id"), start.cast("bigint").alias("start"), (start + 59).cast("bigint").alias("end"),
        F.when(F.col("is_element.length") % 2 == 0, 1).otherwise(-1).alias("strand"),
    )
    records = _elements(spark, sf).select(F.col("is_id").alias("id"), F.coalesce("is_element.sequence", F.lit("")).alias("sequence"))
    return probes, records


def hit_sequences_first(spark: SparkSession, sf: str) -> DataFrame:
    probes, records = _probes(spark, sf)
    return with_genomic_sequence(probes, records, F.col("id")).select("is_id", "contig_id", "genomic_sequence")


def hit_sequences_last(spark: SparkSession, sf: str) -> DataFrame:
    probes, records = _probes(spark, sf)
    hits = probes.select("is_id", F.col("contig_id").alias("target_id"), F.col("start").alias("target_start"), F.col("end").alias("target_end"))
    return with_target_sequence(hits, records, F.col("id"), context=10).select("is_id", "target_id", "sequence")


def retrieved_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Of the hits of both ways of retrieval, how many got a sequence."""
    first = retrieval_counts(hit_sequences_first(spark, sf), "genomic_sequence").withColumn("way", F.lit("first"))
    return first.unionByName(retrieval_counts(hit_sequences_last(spark, sf), "sequence").withColumn("way", F.lit("last")))


def length_warnings(spark: SparkSession, sf: str) -> DataFrame:
    warned = _regions(spark, sf).select("is_id", "region_no", S.length_warning("seq").alias("warning"))
    return warned.where("warning is not null")


def flank_region_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return element_pairs(_aligned_elements(spark, sf)).drop("pair_id")


def guide_alignments(spark: SparkSession, sf: str) -> DataFrame:
    found = element_alignments(_aligned_elements(spark, sf))
    return found.select("is_id", "flanking_source", "region_index", "pos1", "pos2", "length", "orientation", "mismatches", "seq1", "seq2")


def guide_alignments_mismatched(spark: SparkSession, sf: str) -> DataFrame:
    found = element_alignments(_aligned_elements(spark, sf), Finder(min_length=14, max_mismatches=2))
    return found.select("is_id", "flanking_source", "region_index", "pos1", "pos2", "length", "orientation", "mismatches")


def _banded(rows: DataFrame) -> DataFrame:
    found = element_alignments(rows, Finder(min_length=14, max_mismatches=2))
    return with_alignment_columns(deduplicated_alignments(found, F.col("region_index"), F.col("pos1")))


def alignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per element its deduplicated alignments, in all and by quality band, and their mean identity; 0 where it has none."""
    rows = _aligned_elements(spark, sf)
    counts = _banded(rows).groupBy("is_id").agg(
        F.count("*").alias("n"), F.count_if("is_exact").alias("n_exact"), F.count_if("is_short").alias("n_short"), F.round(F.avg("identity"), 6).alias("identity")
    )
    return rows.select("is_id").join(counts, "is_id", "left").na.fill(0, ["n", "n_exact", "n_short"])


def alignment_description(spark: SparkSession, sf: str) -> DataFrame:
    found = describe(_banded(_aligned_elements(spark, sf)), ["length", "mismatches", "identity"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "q25", "median", "q75", "max")})


def guide_alignments_gapped(spark: SparkSession, sf: str) -> DataFrame:
    found = element_alignments(_aligned_elements(spark, sf), gaps=True, min_identity=0.45)
    return found.where("gapped is not null").select("is_id", "flanking_source", "region_index", "gapped.*")


def flank_repeats(spark: SparkSession, sf: str) -> DataFrame:
    flanks = _elements(spark, sf).select(F.col("is_id").alias("pair_id"), F.col("flanking_upstream.sequence").alias("seq"))
    found = find_within(flanks, Finder(min_length=9))
    return found.select(F.col("pair_id").alias("is_id"), "pos1", "pos2", "length", "orientation", "distance")


def _judged(spark: SparkSession, sf: str, pipeline: P.Pipeline, gaps: bool = False) -> DataFrame:
    return P.apply_filters(filter_inputs(element_alignments(_aligned_elements(spark, sf), gaps=gaps)), pipeline)


def guide_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v, m = F.col("verdict"), F.col("verdict.metrics")
    return _judged(spark, sf, P.default_pipeline()).select(
        "is_id", "flanking_source", "region_index", "pos1", "pos2", "orientation", v["pass"].alias("pass"), v["confidence"].alias("confidence"),
        F.array_join(v["failed_filters"], ",").alias("failed_filters"), m["at_content"].alias("at_content"), F.round(F.log10(m["e_value"]), 6).alias("log_e"),
        m["search_space"].alias("search_space"), m["distance_to_start"].alias("distance_to_start"), m["distance_to_end"].alias("distance_to_end"),
    )


def filter_details(spark: SparkSession, sf: str) -> DataFrame:
    """What every filter says of every alignment: passed, and the kind of its reason, also of those passed with low confidence."""
    pipeline = P.default_pipeline().add("length_confidence", P.Level.LENGTH)
    rows = _judged(spark, sf, pipeline).select(
        "is_id", "flanking_source", "region_index", "pos1", "pos2", "orientation", F.explode("verdict.filter_details").alias("filter", "d")
    )
    return rows.select(
        *rows.columns[:-1], "d.passed", F.substring_index("d.reason", ":", 1).alias("reason"), F.col("d.metrics")["confidence"].alias("confidence")
    )


def _summary(make):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return P.summarise(_judged(spark, sf, make()), make())

    return query


def gapped_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.summarise(_judged(spark, sf, P.default_pipeline(), gaps=True), P.default_pipeline(), "flanking_source")


def guide_counts(spark: SparkSession, sf: str) -> DataFrame:
    return process_elements(_aligned_elements(spark, sf), P.default_pipeline()).select(
        "is_id", "sample", "is_element_length", "num_noncoding_regions", "total_hits", "passed", "failed", "by_high", "by_low", "by_rejected"
    )


def region_dedup(spark: SparkSession, sf: str) -> DataFrame:
    hits = _regions(spark, sf).select(F.col("is_id").alias("query_id"), F.col("region_no").alias("hit_id"), F.length("seq").cast("double").alias("bit_score"), F.col("seq").alias("sequence"))
    return deduplicate_hits(hits, 0.3)


def _flanks_in_regions(search, spark: SparkSession, sf: str) -> DataFrame:
    """Both whole flanks of every element, searched in all regions; a query is named by its element and side."""
    sides = [F.struct(F.lit(side).alias("side"), F.col(f"flanking_{side}.sequence").alias("query")) for side in ("upstream", "downstream")]
    parts = [F.struct(f"flanking_{side}.sequence").alias(f"flanking_{side}") for side in ("upstream", "downstream")]
    rows = newest_elements(table(spark, sf, "is_elements"), parts)
    queries = rows.select("is_id", F.explode(F.array(*sides)).alias("x")).select(F.concat_ws(":", "is_id", "x.side").alias("query_id"), "x.query")
    targets = _regions(spark, sf).select(F.concat_ws(":", "is_id", "region_no").alias("target_id"), F.col("seq").alias("sequence"))
    return search(queries, targets).withColumns({c: F.round(c, 6) for c in ("identity", "coverage")})


def flank_search(spark: SparkSession, sf: str) -> DataFrame:
    return _flanks_in_regions(search_words, spark, sf)


def flank_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _flanks_in_regions(search_segments, spark, sf)


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _elements(spark, sf)
    found = deduplicated_alignments(element_alignments(rows), F.col("region_index"), F.col("pos1"))
    return rows, element_features(rows, found)


def annotated_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)[1]


def annotated_records(spark: SparkSession, sf: str) -> DataFrame:
    return flat_file(*_features(spark, sf))


def diagram_arcs(spark: SparkSession, sf: str) -> DataFrame:
    arcs = arc_features(_features(spark, sf)[1])
    return arcs.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("region_middles", "flank_middles")})


def transposition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Both flanks of every element against each other, and gapped extension of the best three matches."""
    rows = _elements(spark, sf).select(F.col("is_id").alias("pair_id"), F.col("flanking_upstream.sequence").alias("s1"), F.col("flanking_downstream.sequence").alias("s2"))
    found = find_between(rows, Finder(min_length=8))
    from seqloom.operators.analytics import best_per_group

    best = best_per_group(found, ["pair_id"], [F.desc("length"), F.col("mismatches"), F.col("pos1"), F.col("pos2"), F.col("orientation")], 3)
    gapped = extend_with_gaps(best.join(rows, "pair_id"), min_identity=0.5).where("gapped is not null")
    top = best_per_group(gapped, ["pair_id"], [F.desc("gapped.identity"), F.col("rank")], 1)
    return top.select(F.col("pair_id").alias("is_id"), "gapped.*")


def guide_candidates_by_element(spark: SparkSession, sf: str) -> DataFrame:
    found = candidates_by_element(guide_candidates(_aligned_elements(spark, sf)))
    return found.select("is_id", "n_candidates", F.array_join(F.transform("alignments", lambda a: a["length"].cast("string")), ",").alias("lengths"))


def diagram_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _elements(spark, sf)
    found = deduplicated_alignments(element_alignments(rows), F.col("region_index"), F.col("pos1"))
    made = element_features(rows, found, by_length_field=True)
    return made.select("is_id", "feature_type", "feature_start", "feature_end", "strand", "label")


QUERIES = {
    "guide_candidates_by_element": guide_candidates_by_element,
    "diagram_features": diagram_features,
    "sequence_metrics": sequence_metrics,
    "flank_identity": flank_identity,
    "orf_regions": orf_regions,
    "hit_sequences_first": hit_sequences_first,
    "hit_sequences_last": hit_sequences_last,
    "retrieved_sequences": retrieved_sequences,
    "length_warnings": length_warnings,
    "filter_details": filter_details,
    "flank_region_pairs": flank_region_pairs,
    "guide_alignments": guide_alignments,
    "guide_alignments_mismatched": guide_alignments_mismatched,
    "alignment_counts": alignment_counts,
    "alignment_description": alignment_description,
    "guide_alignments_gapped": guide_alignments_gapped,
    "flank_repeats": flank_repeats,
    "guide_verdicts": guide_verdicts,
    "filter_summary_default": _summary(P.default_pipeline),
    "filter_summary_strict": _summary(P.strict_pipeline),
    "filter_summary_relaxed": _summary(P.relaxed_pipeline),
    "filter_summary_legacy": _summary(P.legacy_pipeline),
    "filter_summary_gapped": gapped_summary,
    "guide_counts": guide_counts,
    "region_dedup": region_dedup,
    "flank_search": flank_search,
    "flank_segments": flank_segments,
    "annotated_features": annotated_features,
    "annotated_records": annotated_records,
    "diagram_arcs": diagram_arcs,
    "transposition_pairs": transposition_pairs,
}

_ID = "nullif(trim({0}, ' ' || chr(9)), '')"
_CUR = f"""WITH cur AS (SELECT * EXCLUDE (is_id, rn), key AS is_id FROM (SELECT *, {_ID.format('is_id')} AS key, row_number() OVER (PARTITION BY {_ID.format('is_id')} ORDER BY loaded_at DESC) AS rn
  FROM is_elements WHERE {_ID.format('is_id')} IS NOT NULL) WHERE rn = 1)"""
_REGIONS = _CUR + """, r0 AS (SELECT is_id, unnest(orf_annotation.noncoding_regions) AS r, (generate_subscripts(orf_annotation.noncoding_regions, 1) - 1)::INT AS region_no FROM cur),
reg AS (SELECT is_id, region_no, r.sequence AS seq, upper(r.sequence) AS u FROM r0 WHERE r.sequence IS NOT NULL)
"""
_RC = "reverse(translate({0}, 'ACGTacgtRYMKrymkBVDHbvdh', 'TGCAtgcaYRKMyrkmVBHDvbhd'))"
_PAIRS_OF = [f"(length({{0}}) - length(replace({{0}}, '{a}{b}', ''))) / 2" for a in "ACGT" for b in "ACGT" if a != b]


def _at(u: str, letters: str = "AT") -> str:
    return f"CASE WHEN length({u}) = 0 THEN 0 ELSE 100.0 * (length({u}) - length(translate({u}, '{letters}', ''))) / length({u}) END"


def _entropy(u: str) -> str:
    share = f"((length({u}) - length(replace({u}, c, '')))::DOUBLE / length({u}))"
    return f"CASE WHEN length({u}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(string_split({u}, '')), lambda c: -{share} * log2({share}))) END"


def _run(u: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({u}, 'A+|C+|G+|T+'), lambda x: length(x))), 0)::INT"


def _dinucleotide(u: str) -> str:
    return f"CASE WHEN length({u}) < 2 THEN 0 ELSE greatest({', '.join(p.format(u) for p in _PAIRS_OF)}) / (length({u}) - 1) END"


_ALIGNED = (
    _REGIONS
    + """, fl AS (SELECT is_id, sample, is_element.length AS is_length, 'upstream' AS flanking_source, upper(flanking_upstream.sequence) AS s1 FROM cur
  UNION ALL SELECT is_id, sample, is_element.length, 'downstream', upper(flanking_downstream.sequence) FROM cur),
pairs AS (SELECT fl.*, region_no AS region_index, upper(r.sequence) AS s2, coalesce(r.start, 0) AS ncs, coalesce(r."end", 0) AS nce, coalesce(r.length, length(r.sequence)) AS ncl
  FROM fl JOIN r0 USING (is_id) WHERE length(s1) > 0 AND length(r.sequence) > 0),
w1 AS (SELECT *, substr(s1, i::INT + 1, 8) AS k FROM (SELECT *, unnest(range(length(s1) - 7)) AS i FROM pairs WHERE length(s1) >= 8)),
w2 AS (SELECT is_id, flanking_source, region_index, j, substr(s2, j::INT + 1, 8) AS k2 FROM (SELECT *, unnest(range(length(s2) - 7)) AS j FROM pairs WHERE length(s2) >= 8)),
fwd AS (SELECT w1.is_id, w1.flanking_source, w1.region_index, i, j FROM w1 JOIN w2 ON w1.is_id = w2.is_id AND w1.flanking_source = w2.flanking_source AND w1.region_index = w2.region_index AND k = k2),
isl AS (SELECT is_id, flanking_source, region_index, 0 AS o, min(i) AS i, min(j) AS j, min(i) AS p1, min(j) AS p2, max(i) - min(i) + 8 AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY is_id, flanking_source, region_index, j - i ORDER BY i) AS g FROM fwd) GROUP BY is_id, flanking_source, region_index, j - i, g),
rev AS (SELECT w1.is_id, w1.flanking_source, w1.region_index, i, j, s1, s2, least(length(s1) - i, length(s2) - j) - 8 AS most
  FROM w1 JOIN w2 ON w1.is_id = w2.is_id AND w1.flanking_source = w2.flanking_source AND w1.region_index = w2.region_index AND k = """
    + _RC.format("k2")
    + """),
rev1 AS (SELECT *, coalesce(list_min(list_filter(range(1, most + 1), lambda l: substr(s1, i::INT + 1, 8 + l::INT) <> """
    + _RC.format("substr(s2, j::INT + 1, 8 + l::INT)")
    + """)), most + 1) - 1 + 8 AS n1 FROM rev),
rev2 AS (SELECT *, coalesce(list_min(list_filter(range(1, least(i, j) + 1), lambda l: substr(s1, (i - l)::INT + 1, (n1 + l)::INT) <> """
    + _RC.format("substr(s2, (j - l)::INT + 1, (n1 + l)::INT)")
    + """)), least(i, j) + 1) - 1 AS g FROM rev1),
m AS (SELECT * FROM isl UNION ALL SELECT is_id, flanking_source, region_index, 1, min(i), arg_min(j, i * 1000000 + j), i - g, j - g, n1 + g FROM rev2 GROUP BY is_id, flanking_source, region_index, i - g, j - g, n1 + g),
lists AS (SELECT is_id, flanking_source, region_index, list([{'o': o, 'p1': p1, 'p2': p2, 'n': n}] ORDER BY n DESC, i, o, j) AS a FROM m GROUP BY ALL),
kept AS (SELECT is_id, flanking_source, region_index, unnest(list_reduce(a, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.o = x[1].o
    AND y.p1 < x[1].p1 + x[1].n AND x[1].p1 < y.p1 + y.n AND y.p2 < x[1].p2 + x[1].n AND x[1].p2 < y.p2 + y.n)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM lists),
al AS (SELECT p.*, k.p1::INT AS pos1, k.p2::INT AS pos2, k.n::INT AS n, CASE k.o WHEN 0 THEN 'forward' ELSE 'reverse_complement' END AS orientation,
    substr(s1, k.p1::INT + 1, k.n::INT) AS seq1, substr(s2, k.p2::INT + 1, k.n::INT) AS seq2 FROM kept JOIN pairs p USING (is_id, flanking_source, region_index))
"""
)


def _found(keys: str, w: int, k: int, least: str = "") -> str:
    """Alignments with up to k mismatches of the table ``pairs`` (keys, s1, s2), by comparing all words: ``al`` with p1, p2, n, m, o."""
    turned = lambda at, n: _RC.format(f"substr(s2, ({at})::INT + 1, ({n})::INT)")
    away = lambda i, j, n: f"CASE o WHEN 0 THEN hamming(substr(s1, ({i})::INT + 1, ({n})::INT), substr(s2, ({j})::INT + 1, ({n})::INT)) ELSE hamming(substr(s1, ({i})::INT + 1, ({n})::INT), {turned(j, n)}) END"
    return f""", wi AS (SELECT *, unnest(range(length(s1) - {w - 1})) AS i FROM pairs WHERE length(s1) >= {w} AND length(s2) >= {w}),
wj AS (SELECT *, unnest(range(length(s2) - {w - 1})) AS j FROM wi),
wo AS (SELECT *, unnest([0, 1]) AS o FROM wj {f'WHERE j - i >= {least}' if least else ''}),
sd AS (SELECT *, least(length(s1) - i, length(s2) - j) - {w} AS most FROM wo WHERE {away('i', 'j', w)} <= {k}),
g1 AS (SELECT *, coalesce(list_min(list_filter(range(1, most + 1), lambda l: {away('i', 'j', f'{w} + l')} > {k})), most + 1) - 1 + {w} AS n1 FROM sd),
g2 AS (SELECT *, coalesce(list_min(list_filter(range(1, least(i, j) + 1), lambda l: {away('i - l', 'j - l', 'n1 + l')} > {k})), least(i, j) + 1) - 1 AS g FROM g1),
g3 AS (SELECT {keys}, s1, s2, o, i, j, i - g AS p1, j - g AS p2, n1 + g AS n FROM g2),
g4 AS (SELECT *, {away('p1', 'p2', 'n')} AS m FROM g3),
g5 AS (SELECT {keys}, o, p1, p2, n, m, min(i * 1000000 + j) AS seed FROM g4 GROUP BY ALL),
gl AS (SELECT {keys}, list([{{'o': o, 'p1': p1, 'p2': p2, 'n': n, 'm': m}}] ORDER BY n DESC, m, seed // 1000000, o, seed) AS a FROM g5 GROUP BY ALL),
gk AS (SELECT {keys}, unnest(list_reduce(a, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.o = x[1].o
    AND y.p1 < x[1].p1 + x[1].n AND x[1].p1 < y.p1 + y.n AND y.p2 < x[1].p2 + x[1].n AND x[1].p2 < y.p2 + y.n)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM gl),
al AS (SELECT {keys}, x.p1::INT AS pos1, x.p2::INT AS pos2, x.n::INT AS length, CASE x.o WHEN 0 THEN 'forward' ELSE 'reverse_complement' END AS orientation, x.m::INT AS mismatches FROM gk)
"""


_MISMATCHED = (
    _REGIONS
    + """, fl AS (SELECT is_id, 'upstream' AS flanking_source, upper(flanking_upstream.sequence) AS s1 FROM cur UNION ALL SELECT is_id, 'downstream', upper(flanking_downstream.sequence) FROM cur),
pairs AS (SELECT fl.*, region_no AS region_index, coalesce(r.start, 0) AS ncs, upper(r.sequence) AS s2 FROM fl JOIN r0 USING (is_id) WHERE length(s1) > 0 AND length(r.sequence) > 0)"""
    + _found("is_id, flanking_source, region_index, ncs", 14, 2)
)
_BANDED = (
    _MISMATCHED
    + """, bands AS (SELECT *, 1 - mismatches / length AS identity, mismatches = 0 AND length >= 12 AS is_exact, length BETWEEN 9 AND 15 AND mismatches <= 1 AS is_short FROM al
  QUALIFY row_number() OVER (PARTITION BY is_id, flanking_source, ncs, pos2, length, orientation ORDER BY region_index, pos1) = 1)
"""
)


def _judge(at: float, entropy: float, run: int, reject: float, low: float, high: float) -> str:
    """Verdicts of the significance pipelines over ``al``."""
    return _ALIGNED + f""", met AS (SELECT *, {_at('seq1')} AS atp, {_entropy('seq1')} AS ent, {_run('seq1')} AS run, {_dinucleotide('seq1')} AS di,
    greatest(1, length(s1) - n + 1) * greatest(1, ncl - n + 1) AS space, abs(ncs - 1) AS ds, abs(nce - coalesce(is_length, 0)) AS de FROM al),
e AS (SELECT *, exp(ln(space) - n * ln(4)) AS ev FROM met),
v AS (SELECT *, atp > {at} AS f1, ent < {entropy} AS f2, run > {run} AS f3, di > 0.8 AS f4, ev > {reject} AS f5, least(ds, de) < 10 AS f6 FROM e),
j AS (SELECT *, NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS pass, CASE WHEN ev > {reject} OR ev <= {high} THEN 'high' ELSE 'low' END AS confidence FROM v)
"""


_COUNTS = """count(*) AS total, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed, count(*) FILTER (pass AND confidence = 'high') AS by_high,
  count(*) FILTER (pass AND confidence = 'low') AS by_low, count(*) FILTER (NOT pass) AS by_rejected"""
_FAILS = """count(*) FILTER (f1) AS failed_at_content, count(*) FILTER (f2) AS failed_entropy, count(*) FILTER (f3) AS failed_homopolymer,
  count(*) FILTER (f4) AS failed_dinucleotide"""
_SIGNIFICANCE = "count(*) FILTER (f5) AS failed_statistical_significance, count(*) FILTER (f6) AS failed_boundary_artifact"
_DEFAULT = _judge(75.0, 1.5, 5, 0.01, 1e-3, 1e-6)
_PROBES = _CUR + """, probes AS (SELECT is_id, substr(is_id, 1, 10) AS contig_id, is_element.length % 1500 + 1 AS s, is_element.length % 1500 + 60 AS e,
    CASE WHEN is_element.length % 2 = 0 THEN 1 ELSE -1 END AS strand FROM cur WHERE is_element.length IS NOT NULL),
rec AS (SELECT is_id AS id, coalesce(is_element.sequence, '') AS sequence FROM cur)
"""

ORACLES = {
    "guide_candidates_by_element": _DEFAULT
    + "SELECT is_id, count(*) AS n_candidates, string_agg(n::VARCHAR, ',' ORDER BY flanking_source, region_index, pos1, pos2, n, orientation) AS lengths FROM j WHERE pass GROUP BY is_id",
    "diagram_features": _ALIGNED
    + """, z AS (SELECT *, coalesce(flanking_upstream.length, 0) AS up, coalesce(is_element.length, 0) AS own, coalesce(flanking_downstream.length, 0) AS down FROM cur),
o AS (SELECT is_id, up, unnest(orf_annotation.orfs) AS x FROM z), r AS (SELECT is_id, up, unnest(orf_annotation.noncoding_regions) AS x FROM z),
d AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY is_id, flanking_source, ncs, pos2, n, orientation ORDER BY region_index, pos1) = 1),
b AS (SELECT d.*, up, own, down, 'aln_' || flanking_source || '_' || n || 'bp_' AS lab FROM d JOIN z USING (is_id))
SELECT is_id, 'misc_feature' AS feature_type, 0::BIGINT AS feature_start, up::BIGINT AS feature_end, 0 AS strand, 'upstream_flanking' AS label FROM z WHERE up > 0
UNION ALL SELECT is_id, 'misc_feature', up + own, up + own + down, 0, 'downstream_flanking' FROM z WHERE down > 0
UNION ALL SELECT is_id, 'misc_feature', up, up + own, 0, is_id FROM z
UNION ALL SELECT is_id, 'CDS', up + x.start - 1, up + x."end", CASE WHEN coalesce(x.strand, '+') = '+' THEN 1 ELSE -1 END, coalesce(x.orf_id, '') FROM o WHERE x IS NOT NULL
UNION ALL SELECT is_id, 'misc_feature', up + x.start - 1, up + x."end", 0, coalesce(x.type, 'noncoding') FROM r WHERE x IS NOT NULL
UNION ALL SELECT is_id, 'misc_binding', up + ncs - 1 + pos2, up + ncs - 1 + pos2 + n, 0, lab || 'nc' FROM b
UNION ALL SELECT is_id, 'misc_binding', CASE flanking_source WHEN 'upstream' THEN 0 ELSE up + own END + pos1, CASE flanking_source WHEN 'upstream' THEN 0 ELSE up + own END + pos1 + n, 0, lab || 'flank' FROM b
  WHERE CASE flanking_source WHEN 'upstream' THEN up ELSE down END > 0""",
    "sequence_metrics": _REGIONS
    + f"""SELECT is_id, region_no, {_RC.format('seq')} AS turned, round({_at('u')}, 6) AS at, round({_at('u', 'GC')}, 6) AS gc, round({_entropy('u')}, 6) AS entropy, {_run('u')} AS run,
  regexp_matches(u, 'A{{5}}|T{{5}}|G{{5}}|C{{5}}') AS has_run, round({_dinucleotide('u')}, 6) AS dinucleotide, length(u) >= 6 AND {_dinucleotide('u')} >= 0.2 AS has_repeat FROM reg""",
    "flank_identity": _CUR
    + """, f AS (SELECT is_id, flanking_upstream.sequence AS up, flanking_downstream.sequence AS down FROM cur),
g AS (SELECT *, upper(left(up, least(length(up), length(down)))) AS a, upper(left(down, least(length(up), length(down)))) AS b FROM f WHERE up IS NOT NULL AND down IS NOT NULL),
h AS (SELECT *, coalesce(len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i::INT, 1) <> substr(b, i::INT, 1))), 0)::INT AS mismatches FROM g)
SELECT is_id, round(CASE WHEN length(a) = 0 THEN 0 ELSE (length(a) - mismatches) / greatest(length(up), length(down)) END, 6) AS identity, mismatches, (length(a) - mismatches)::INT AS matches,
  right(up, 50) AS inner_up, left(down, 50) AS inner_down FROM h""",
    "orf_regions": _CUR
    + """, g0 AS (SELECT is_id AS contig_id, is_element.sequence AS s, unnest(orf_annotation.orfs) AS o, (generate_subscripts(orf_annotation.orfs, 1) - 1)::INT AS orf_no FROM cur),
g1 AS (SELECT contig_id, orf_no, s, o.start AS b, o."end" AS e, coalesce(o.strand, '+') = '+' AS fw, length(s) AS n FROM g0 WHERE o IS NOT NULL),
g AS (SELECT *, CASE WHEN s IS NULL THEN 'unknown_contig' WHEN b IS NULL OR b < 1 THEN 'start_below_1' WHEN e IS NULL OR e > n THEN 'end_beyond_contig' WHEN b > e THEN 'start_after_end' END AS problem FROM g1),
x AS (SELECT *, CASE WHEN fw THEN greatest(b - 35, 1) ELSE e + 1 END AS ub, CASE WHEN fw THEN b - 1 ELSE least(e + 35, n) END AS ue, CASE WHEN fw THEN e + 1 ELSE greatest(b - 25, 1) END AS db,
    CASE WHEN fw THEN least(e + 25, n) ELSE b - 1 END AS de FROM g),
y AS (SELECT *, greatest(ue - ub + 1, 0) AS ul, greatest(de - db + 1, 0) AS dl FROM x)
SELECT contig_id, orf_no, problem, """
    + ", ".join(
        f"CASE WHEN problem IS NULL THEN {b} END AS {p}_start, CASE WHEN problem IS NULL THEN {b} + {n} - 1 END AS {p}_end, CASE WHEN problem IS NULL THEN {n} END AS {p}_length, "
        f"CASE WHEN problem IS NULL THEN CASE WHEN fw THEN substr(s, {b}::INT, {n}::INT) ELSE {_RC.format(f'substr(s, {b}::INT, {n}::INT)')} END END AS {p}_sequence"
        for p, b, n in (("coding", "b", "(e - b + 1)"), ("upstream", "ub", "ul"), ("downstream", "db", "dl"))
    )
    + " FROM y",
    "hit_sequences_first": _PROBES
    + f""", m AS (SELECT p.is_id, id, substr(sequence, s::INT, greatest(least(length(sequence), e) - s + 1, 0)::INT) AS part, strand FROM probes p JOIN rec ON starts_with(id, contig_id)),
b AS (SELECT is_id, arg_min(CASE WHEN strand = -1 THEN {_RC.format('part')} ELSE part END, id) AS genomic_sequence FROM m WHERE length(part) > 0 GROUP BY is_id)
SELECT is_id, contig_id, genomic_sequence FROM probes LEFT JOIN b USING (is_id)""",
    "hit_sequences_last": _PROBES
    + """, b AS (SELECT contig_id, arg_max(sequence, id) AS whole FROM (SELECT DISTINCT contig_id FROM probes) JOIN rec ON starts_with(id, contig_id) GROUP BY contig_id)
SELECT is_id, contig_id AS target_id, substr(whole, greatest(s - 10, 1)::INT, greatest(least(length(whole), e + 10) - greatest(s - 10, 1) + 1, 0)::INT) AS sequence FROM probes LEFT JOIN b USING (contig_id)""",
    "retrieved_sequences": _PROBES
    + f""", m AS (SELECT p.is_id, substr(sequence, s::INT, greatest(least(length(sequence), e) - s + 1, 0)::INT) AS part FROM probes p JOIN rec ON starts_with(id, contig_id)),
t AS (SELECT count(*) AS n_hits, count(*) FILTER (contig_id IN (SELECT contig_id FROM probes JOIN rec ON starts_with(id, contig_id))) AS n_last FROM probes)
SELECT 'first' AS way, n_hits, (SELECT count(DISTINCT is_id) FROM m WHERE length(part) > 0) AS n_found FROM t UNION ALL SELECT 'last', n_hits, n_last FROM t""",
    "flank_region_pairs": _CUR
    + """, r0 AS (SELECT is_id, unnest(orf_annotation.noncoding_regions) AS r, (generate_subscripts(orf_annotation.noncoding_regions, 1) - 1)::INT AS region_index FROM cur),
fl AS (SELECT is_id, sample, is_element.length AS is_length, 'upstream' AS flanking_source, flanking_upstream.sequence AS s1 FROM cur UNION ALL SELECT is_id, sample, is_element.length, 'downstream', flanking_downstream.sequence FROM cur)
SELECT is_id, sample, is_length, flanking_source, region_index, length(s1)::INT AS flanking_length, coalesce(r.type, '') AS region_type, coalesce(r.start, 0) AS noncoding_start, coalesce(r."end", 0) AS noncoding_end,
  coalesce(r.length, length(r.sequence))::INT AS noncoding_length, s1, r.sequence AS s2 FROM fl JOIN r0 USING (is_id) WHERE length(s1) > 0 AND length(r.sequence) > 0""",
    "guide_alignments": _ALIGNED + "SELECT is_id, flanking_source, region_index, pos1, pos2, n AS length, orientation, 0 AS mismatches, seq1, seq2 FROM al",
    "guide_alignments_mismatched": _MISMATCHED + "SELECT is_id, flanking_source, region_index, pos1, pos2, length, orientation, mismatches FROM al",
    "alignment_counts": _BANDED
    + """SELECT is_id, count(b.length) AS n, count(*) FILTER (is_exact) AS n_exact, count(*) FILTER (is_short) AS n_short, round(avg(identity), 6) AS identity FROM cur LEFT JOIN bands b USING (is_id) GROUP BY is_id""",
    "alignment_description": _BANDED
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM bands"
        for c in ("length", "mismatches", "identity")
    ),
    "flank_repeats": _CUR
    + ", pairs AS (SELECT is_id, upper(flanking_upstream.sequence) AS s1, upper(flanking_upstream.sequence) AS s2 FROM cur)"
    + _found("is_id", 9, 0, "9")
    + "SELECT is_id, pos1, pos2, length, orientation, pos2 - pos1 AS distance FROM al",
    "guide_verdicts": _DEFAULT
    + """SELECT is_id, flanking_source, region_index, pos1, pos2, orientation, pass, confidence, concat_ws(',', CASE WHEN f1 THEN 'at_content' END, CASE WHEN f2 THEN 'entropy' END,
  CASE WHEN f3 THEN 'homopolymer' END, CASE WHEN f4 THEN 'dinucleotide' END, CASE WHEN f5 THEN 'statistical_significance' END, CASE WHEN f6 THEN 'boundary_artifact' END) AS failed_filters,
  round_even(atp, 2) AS at_content, round(log10(ev), 6) AS log_e, space::BIGINT AS search_space, ds AS distance_to_start, de AS distance_to_end FROM j""",
    "filter_details": _DEFAULT
    + """SELECT is_id, flanking_source, region_index, pos1, pos2, orientation, x.f AS filter, NOT x.bad AS passed, x.why AS reason, x.c AS confidence FROM (SELECT *, unnest([
  {'f': 'at_content', 'bad': f1, 'why': CASE WHEN f1 THEN 'AT_CONTENT_TOO_HIGH' ELSE '' END, 'c': NULL}, {'f': 'entropy', 'bad': f2, 'why': CASE WHEN f2 THEN 'LOW_COMPLEXITY' ELSE '' END, 'c': NULL},
  {'f': 'homopolymer', 'bad': f3, 'why': CASE WHEN f3 THEN 'HOMOPOLYMER_TOO_LONG' ELSE '' END, 'c': NULL}, {'f': 'dinucleotide', 'bad': f4, 'why': CASE WHEN f4 THEN 'DINUCLEOTIDE_REPEAT' ELSE '' END, 'c': NULL},
  {'f': 'statistical_significance', 'bad': f5, 'why': CASE WHEN f5 THEN 'E_VALUE_TOO_HIGH' WHEN ev > 1e-3 THEN 'LOW_CONFIDENCE_EVALUE' ELSE '' END, 'c': CASE WHEN f5 THEN 'rejected' WHEN ev > 1e-6 THEN 'low' ELSE 'high' END},
  {'f': 'boundary_artifact', 'bad': f6, 'why': CASE WHEN f6 THEN 'BOUNDARY_ARTIFACT' ELSE '' END, 'c': NULL},
  {'f': 'length_confidence', 'bad': n < 9, 'why': CASE WHEN n < 9 THEN 'LENGTH_REJECTED' WHEN n < 14 THEN 'LOW_CONFIDENCE_LENGTH' ELSE '' END, 'c': CASE WHEN n < 9 THEN 'rejected' WHEN n < 14 THEN 'low' ELSE 'high' END}]) AS x FROM j)""",
    "length_warnings": _REGIONS
    + "SELECT is_id, region_no, 'Sequence length (' || length(trim(seq)) || 'bp) is outside recommended range (50-200bp)' AS warning FROM reg WHERE NOT length(trim(seq)) BETWEEN 50 AND 200",
    "filter_summary_default": _DEFAULT + f"SELECT {_COUNTS}, {_FAILS}, {_SIGNIFICANCE} FROM j",
    "filter_summary_strict": _judge(70.0, 1.8, 4, 1e-3, 1e-6, 1e-9) + f"SELECT {_COUNTS}, {_FAILS}, {_SIGNIFICANCE} FROM j",
    "filter_summary_relaxed": _judge(80.0, 1.2, 6, 0.05, 0.01, 1e-3) + f"SELECT {_COUNTS}, {_FAILS}, {_SIGNIFICANCE} FROM j",
    "filter_summary_legacy": _judge(75.0, 1.5, 5, 0.01, 1e-3, 1e-6)
    + f""", l AS (SELECT * REPLACE (NOT (f1 OR f2 OR f3 OR f4 OR n < 9 OR f6) AS pass, CASE WHEN n < 9 OR n >= 14 THEN 'high' ELSE 'low' END AS confidence) FROM j)
SELECT {_COUNTS}, {_FAILS}, count(*) FILTER (n < 9) AS failed_length_hard_cutoff, count(*) FILTER (n < 9) AS failed_length_confidence, count(*) FILTER (f6) AS failed_boundary_artifact FROM l""",
    "guide_counts": _DEFAULT
    + f""", c AS (SELECT is_id, {_COUNTS} FROM j GROUP BY is_id)
SELECT is_id, sample, coalesce(is_element.length, 0) AS is_element_length, coalesce(len(orf_annotation.noncoding_regions), 0)::INT AS num_noncoding_regions, coalesce(total, 0) AS total_hits, passed, failed, by_high, by_low, by_rejected
FROM cur LEFT JOIN c USING (is_id)""",
    "region_dedup": _REGIONS
    + """, g AS (SELECT is_id AS query_id, list([{'h': region_no, 's': seq, 'u': u}] ORDER BY length(seq) DESC, region_no) FILTER (length(seq) > 0) AS a,
    list([{'h': region_no, 's': NULL::VARCHAR, 'u': u}] ORDER BY region_no) AS b FROM (SELECT DISTINCT is_id, region_no, seq, u FROM reg) GROUP BY is_id),
k AS (SELECT query_id, unnest(list_reduce(coalesce(a, b), lambda acc, x: CASE WHEN x[1].s IS NOT NULL AND len(list_filter(acc, lambda y: len(list_filter(range(1, least(length(y.u), length(x[1].u)) + 1),
    lambda i: substr(y.u, i::INT, 1) = substr(x[1].u, i::INT, 1))) / greatest(length(y.u), length(x[1].u)) >= 0.3)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM g)
SELECT query_id, k.h AS hit_id, length(coalesce(k.s, ''))::DOUBLE AS bit_score, k.s AS sequence FROM k""",
    "annotated_features": _ALIGNED
    + """, z AS (SELECT *, coalesce(length(flanking_upstream.sequence), 0) AS up, coalesce(length(is_element.sequence), 0) AS own, coalesce(length(flanking_downstream.sequence), 0) AS down FROM cur),
o AS (SELECT is_id, up, unnest(orf_annotation.orfs) AS x FROM z), r AS (SELECT is_id, up, unnest(orf_annotation.noncoding_regions) AS x FROM z),
d AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY is_id, flanking_source, ncs, pos2, n, orientation ORDER BY region_index, pos1) = 1),
b AS (SELECT d.*, up, own, down, 'aln_' || flanking_source || '_' || n || 'bp_' AS lab, 'orientation=' || orientation || '; flanking_source=' || flanking_source AS note FROM d JOIN z USING (is_id))
SELECT is_id, 'misc_feature' AS feature_type, 0::BIGINT AS feature_start, up::BIGINT AS feature_end, 0 AS strand, 'upstream_flanking' AS label, up || 'bp upstream flanking region' AS note, NULL AS translation FROM z WHERE up > 0
UNION ALL SELECT is_id, 'misc_feature', up + own, up + own + down, 0, 'downstream_flanking', down || 'bp downstream flanking region', NULL FROM z WHERE down > 0
UNION ALL SELECT is_id, 'misc_feature', up, up + own, 0, is_id, own || 'bp IS element', NULL FROM z
UNION ALL SELECT is_id, 'CDS', up + x.start - 1, up + x."end", CASE WHEN coalesce(x.strand, '+') = '+' THEN 1 ELSE -1 END, coalesce(x.orf_id, ''), coalesce(x.length_aa, 0) || 'aa', nullif(x.protein_sequence, '') FROM o WHERE x IS NOT NULL
UNION ALL SELECT is_id, 'misc_feature', up + x.start - 1, up + x."end", 0, coalesce(x.type, 'noncoding'), (x."end" - x.start + 1) || 'bp noncoding region', NULL FROM r WHERE x IS NOT NULL
UNION ALL SELECT is_id, 'misc_binding', up + ncs - 1 + pos2, up + ncs - 1 + pos2 + n, 0, lab || 'nc', note, NULL FROM b
UNION ALL SELECT is_id, 'misc_binding', CASE flanking_source WHEN 'upstream' THEN 0 ELSE up + own END + pos1, CASE flanking_source WHEN 'upstream' THEN 0 ELSE up + own END + pos1 + n, 0, lab || 'flank', note, NULL FROM b
  WHERE CASE flanking_source WHEN 'upstream' THEN up ELSE down END > 0""",
    "flank_search": _REGIONS
    + f""", q0 AS (SELECT is_id || ':upstream' AS query_id, upper(flanking_upstream.sequence) AS q FROM cur UNION ALL SELECT is_id || ':downstream', upper(flanking_downstream.sequence) FROM cur),
q AS (SELECT query_id, 1 AS strand, q FROM q0 UNION ALL SELECT query_id, -1, {_RC.format('q')} FROM q0),
t AS (SELECT is_id || ':' || region_no AS target_id, u AS t FROM reg),
qw AS (SELECT query_id, strand, i, substr(q, i::INT + 1, 12) AS k FROM (SELECT *, unnest(range(length(q) - 11)) AS i FROM q WHERE length(q) >= 12)),
tw AS (SELECT target_id, j, substr(t, j::INT + 1, 12) AS k FROM (SELECT *, unnest(range(length(t) - 11)) AS j FROM t WHERE length(t) >= 12)),
l AS (SELECT DISTINCT query_id, strand, target_id, j - i AS shift FROM qw JOIN tw USING (k) WHERE regexp_full_match(k, '[ACGT]+')),
x AS (SELECT *, greatest(-shift, 0) AS b FROM l JOIN q USING (query_id, strand) JOIN t USING (target_id)),
y AS (SELECT *, least(length(q) - b, length(t) - b - shift) AS n FROM x),
z AS (SELECT *, len(list_filter(range(1, n + 1), lambda p: substr(q, (b + p)::INT, 1) = substr(t, (b + shift + p)::INT, 1) AND substr(q, (b + p)::INT, 1) IN ('A', 'C', 'G', 'T'))) AS m FROM y)
SELECT query_id, target_id, strand, (b + 1)::INT AS query_start, (b + n)::INT AS query_end, (b + shift + 1)::INT AS target_start, (b + shift + n)::INT AS target_end, m::INT AS matches, round(m / n, 6) AS identity, round(n / length(q), 6) AS coverage
FROM z WHERE m / n >= 0.8 AND n / length(q) >= 0.15""",
}
ORACLES["diagram_arcs"] = f"""WITH f AS ({ORACLES['annotated_features']}), a AS (SELECT is_id, regexp_replace(label, '_(nc|flank)$', '') AS pair, regexp_extract(label, '_(nc|flank)$', 1) AS side, (feature_start + feature_end) / 2 AS middle, note
  FROM f WHERE feature_type = 'misc_binding')
SELECT is_id, pair, note, coalesce(string_agg(middle::VARCHAR, ',' ORDER BY middle) FILTER (side = 'nc'), '') AS region_middles, coalesce(string_agg(middle::VARCHAR, ',' ORDER BY middle) FILTER (side = 'flank'), '') AS flank_middles FROM a GROUP BY ALL"""
ORACLES["annotated_records"] = f"""WITH f AS ({ORACLES['annotated_features']}), l AS (SELECT *, '     ' || rpad(feature_type, 16, ' ')
    || CASE WHEN strand = -1 THEN 'complement(' || (feature_start + 1) || '..' || feature_end || ')' ELSE (feature_start + 1) || '..' || feature_end END || chr(10) || '                     /label="' || label || '"' AS line FROM f),
t AS (SELECT is_id, string_agg(line, chr(10) ORDER BY feature_start, feature_end, feature_type, label, line) AS tab FROM l GROUP BY is_id),
w AS (SELECT nullif(trim(is_id, ' ' || chr(9)), '') AS is_id, lower(concat_ws('', flanking_upstream.sequence, is_element.sequence, flanking_downstream.sequence)) AS whole FROM is_elements
  WHERE nullif(trim(is_id, ' ' || chr(9)), '') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nullif(trim(is_id, ' ' || chr(9)), '') ORDER BY loaded_at DESC) = 1)
SELECT is_id, 'LOCUS       ' || rpad(is_id, 16, ' ') || ' ' || length(whole) || ' bp    DNA     linear   UNK' || chr(10) || 'DEFINITION  ' || is_id || chr(10) || 'FEATURES             Location/Qualifiers' || chr(10) || tab || chr(10) || 'ORIGIN'
  || chr(10) || list_aggregate(list_transform(range(greatest((length(whole) - 1) // 60, 0) + 1), lambda i: lpad((i * 60 + 1)::VARCHAR, 9, ' ') || ' ' || trim(regexp_replace(substr(whole, (i * 60 + 1)::INT, 60), '(.{{10}})', '\\1 ', 'g'))), 'string_agg', chr(10))
  || chr(10) || '//' AS value FROM w JOIN t USING (is_id)"""
