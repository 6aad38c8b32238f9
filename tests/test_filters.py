"""Filters and statistics: published values, limits, presets, counts."""

import math

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions import statistics as X
from seqloom.operators import filters as P


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("n,k,expected", [(8, 0, 7.63e-3), (9, 0, 1.91e-3), (9, 1, 5.15e-2), (12, 0, 2.98e-5), (15, 0, 4.66e-7), (17, 1, 1.48e-6), (20, 2, 7.78e-7)])
def test_published_evalues(spark, n, k, expected):
    e = one(spark, e=X.ungapped_evalue(F.lit(n), F.lit(k), F.lit(500))).e
    assert float(f"{e:.2e}") == pytest.approx(expected)


def test_impossible_evalues(spark):
    row = one(spark, a=X.ungapped_evalue(F.lit(3), F.lit(4), F.lit(5)), b=X.ungapped_evalue(F.lit(0), F.lit(0), F.lit(5)), c=X.gapped_evalue(F.lit(0), F.lit(5), F.lit(5)), p=X.evalue_to_pvalue(F.lit(701.0)))
    assert row.a == row.b == row.c == math.inf and row.p == 1.0


def test_scoring_lambda():
    x = X.scoring_lambda(2, -1)
    assert x == pytest.approx(0.264497, abs=1e-6) and x == pytest.approx(math.log((math.sqrt(13) - 1) / 2), abs=1e-10)
    for bad in ((0, -1), (2, 1), (3, -1)):
        with pytest.raises(ValueError):
            X.scoring_lambda(*bad)


def test_sequence_functions(spark):
    rows = [("ACGTN", "x"), ("", "x"), (None, "x"), ("aaaaat", "x"), ("ATATAT", "x")]
    df = spark.createDataFrame(rows, "s string, t string")
    out = df.select(
        "s", S.reverse_complement("s").alias("rc"), S.at_content("s").alias("at"), S.gc_content("s").alias("gc"), S.shannon_entropy("s").alias("h"),
        S.longest_homopolymer("s").alias("run"), S.dinucleotide_ratio("s").alias("di"), S.has_dinucleotide_repeat("s", 0.6).alias("rep"),
    ).collect()
    by = {r.s: r for r in out}
    assert (by["ACGTN"].rc, by["ACGTN"].at, by["ACGTN"].gc, by["ACGTN"].run) == ("NACGT", 40.0, 40.0, 1)
    assert by["ACGTN"].h == pytest.approx(math.log2(5))
    assert (by[""].rc, by[""].at, by[""].h, by[""].run, by[""].di) == ("", 0.0, 0.0, 0, 0.0)
    assert all(by[None][c] is None for c in ("rc", "at", "h", "run"))
    assert by["aaaaat"].run == 5 and by["ATATAT"].di == 0.6 and by["ATATAT"].rep
    row = one(spark, a=S.reverse_complement(F.lit("RYMKBVDHNU-")), b=S.sequence_identity(F.lit("ACGT"), F.lit("acgg")), c=S.gap_opens(F.lit("|| |.  |")), d=S.marker_line(F.lit("AC-T"), F.lit("AGGT")), e=S.to_dna(F.lit("AUu")))
    assert (row.a, row.b, row.c, row.d, row.e) == ("-UNDHBVMKRY", 0.75, 2, "|. |", "ATt")
    cut = one(spark, a=S.slice_region(F.lit("ACGTACGT"), F.lit(-3), F.lit(3), F.lit(1)), b=S.slice_region(F.lit("ACGTACGT"), F.lit(7), F.lit(99), F.lit(-1)), c=S.slice_region(F.lit("ACGT"), F.lit(4), F.lit(2), F.lit(1)))
    assert (cut.a, cut.b, cut.c) == ("ACG", "AC", "")


COLUMNS = "aligned_sequence string, mismatches int, gaps int, alignment_string string, query_length int, target_length int, non_coding_start int, non_coding_end int, transposon_start int, transposon_end int, verdict string"


def judge(spark, pipeline, *rows):
    df = spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], COLUMNS)
    return [r.verdict for r in P.apply_filters(df, pipeline).collect()]


def test_verdicts(spark):
    good = "ACGTTGCAAGCTTACG"
    v = judge(spark, P.default_pipeline(), (good, 0, 0, "", 40, 40), ("AAAAAAAAAAAAAAAA", 0, 0, "", 40, 40), ("ACGTTGCA", 0, 0, "", 400, 400), (None,), (good, 0, 0, "", 40, 40, 5, 200, 1, 300))
    assert v[0]["pass"] and v[0].confidence == "high" and v[0].failed_filters == []
    assert v[1].failed_filters == ["at_content", "entropy", "homopolymer"] and v[1].filter_reasons[0] == "AT_CONTENT_TOO_HIGH: 100.0% > 75.0%"
    assert v[1].filter_reasons[1] == "LOW_COMPLEXITY: entropy=0.00 < 1.5"
    assert v[2].failed_filters == ["statistical_significance"] and v[2].confidence == "high"  # a failed grade leaves the last one
    assert v[2].metrics.search_space == 393 * 393 and v[2].filter_reasons[0].startswith("E_VALUE_TOO_HIGH: E=2.36e+00 > 1.00e-02")
    assert v[3]["pass"] and v[3].passed_filters == ["boundary_artifact"]
    assert v[4].failed_filters == ["boundary_artifact"] and v[4].metrics.distance_to_start == 4


def test_gapped_significance(spark):
    pipeline = P.Pipeline().add("statistical_significance", P.Level.LENGTH)
    v = judge(spark, pipeline, ("ACGTACGTACGTACGTACGT", 1, 3, "||||||   |||||||||.|||", 40, 50))[0].metrics
    assert (v.is_gapped, v.gap_opens, v.raw_score) == (True, 1, 16 * 2 - 1 - 3 - 2)
    assert v.e_value == pytest.approx(0.1 * 40 * 50 * math.exp(-26 * X.scoring_lambda()))


def test_pipelines(spark):
    p = P.default_pipeline()
    assert [f.name for f in p.running()] == ["at_content", "entropy", "homopolymer", "dinucleotide", "statistical_significance", "boundary_artifact"]
    assert [f.name for f in P.legacy_pipeline().running()][4:] == ["length_hard_cutoff", "length_confidence", "boundary_artifact"]
    assert P.strict_pipeline().filters[0].params == {"max_at_percent": 70.0}
    assert len(p.disable("entropy").running()) == 5 and p.disable("entropy").enable("entropy") == p
    assert p.add("unknown", P.Level.LENGTH).running() == p.running()
    assert p.with_params("homopolymer", max_homopolymer_length=2).filters[2].params == {"max_homopolymer_length": 2}
    assert judge(spark, P.Pipeline(), ("A",))[0]["pass"]


def test_summary(spark):
    pipeline = P.legacy_pipeline()
    rows = [("ACGTTGCAAGCTTACG", "a"), ("ACGTTGCAAG", "a"), ("ACG", "b"), ("AAAAAAAAAAAA", "b")]
    df = spark.createDataFrame(rows, "aligned_sequence string, k string")
    s = P.summarise(P.apply_filters(df, pipeline), pipeline).first()
    assert (s.total, s.passed, s.failed, s.by_high, s.by_low, s.by_rejected) == (4, 2, 2, 1, 1, 2)
    assert (s.failed_length_hard_cutoff, s.failed_homopolymer, s.failed_dinucleotide) == (1, 1, 0)
    assert P.summarise(P.apply_filters(df.limit(0), pipeline), pipeline).first().total == 0


def test_known_verdicts(spark):
    only = P.Pipeline().add("statistical_significance", P.Level.LENGTH)
    v = judge(spark, only, ("ACGTACGTA", 0, 0, "", 100, 500), ("ACGTACGTA", 0, 0, "", 11, 11), ("ACGTACGTAC", 0, 0, "", 50, 200))
    assert [x.metrics.search_space for x in v] == [92 * 492, 9, 7831]
    assert [x["pass"] for x in v] == [False, True, True] and v[1].confidence == "low"
    inside = lambda s: (s, 0, 0, "", None, None, 120, 150, 100, 200)
    assert [x["pass"] for x in judge(spark, P.default_pipeline(), inside("ACGT" * 4), inside("ACGTACGT"))] == [True, True]
    assert judge(spark, P.legacy_pipeline(), inside("ACGT" * 4))[0]["pass"]
    row = one(spark, a=S.reverse_complement(F.lit("RYWSMK")), b=S.reverse_complement(F.lit("ATgc")), c=X.evalue_to_pvalue(F.lit(0.0)), d=X.evalue_to_pvalue(F.lit(10.0)), e=S.gap_opens(F.lit("   ")), f=S.gap_opens(F.lit("")), g=S.contig_or_empty(F.lit("contig_name_test_456")), h=S.contig_of(F.lit("contig_name"), when_numeric=True))
    assert (row.a, row.b, row.c, row.e, row.f, row.g, row.h) == ("MKSWRY", "gcAT", 0.0, 1, 0, "contig_name_test", "contig_name") and row.d > 0.999
