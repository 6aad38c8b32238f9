"""Configurable filters over alignments: each gives a verdict, a reason and metrics, and all run for every row.

A pipeline is an immutable value on the driver. Applying it adds columns only, so that any number of filters is one
narrow, compiled projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions import statistics as X


class Level(IntEnum):
    COMPOSITION, LENGTH, TOPOLOGY = 1, 2, 3


@dataclass(frozen=True)
class Filter:
    name: str
    level: Level
    params: dict = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class Pipeline:
    """Filters in order. The changing methods give a new pipeline; ``with_params`` changes the first of a name."""

    filters: tuple[Filter, ...] = ()

    def add(self, name: str, level: Level, enabled: bool = True, **params) -> Pipeline:
        return Pipeline((*self.filters, Filter(name, level, params, enabled)))

    def enable(self, name: str, on: bool = True) -> Pipeline:
        return Pipeline(tuple(replace(f, enabled=on) if f.name == name else f for f in self.filters))

    def disable(self, name: str) -> Pipeline:
        return self.enable(name, False)

    def with_params(self, name: str, **params) -> Pipeline:
        first = next((i for i, f in enumerate(self.filters) if f.name == name), None)
        return Pipeline(tuple(replace(f, params={**f.params, **params}) if i == first else f for i, f in enumerate(self.filters)))

    def running(self) -> list[Filter]:
        """The enabled filters of known names, by level; in the given order within a level."""
        return sorted((f for f in self.filters if f.enabled and f.name in FILTERS), key=lambda f: f.level)


@dataclass(frozen=True)
class Verdict:
    """``reason`` says why a row fails, ``doubt`` why it passes with low confidence, if it does."""

    passed: Column
    reason: Column
    metrics: dict[str, Column]
    confidence: Column | None = None
    doubt: Column | None = None


class Inputs(dict):
    """The columns that filters read. What is costly and used often is made ``once``, as a field of one generated struct: an
    optimizer may repeat a projection's work in every field above it, but not a generator's."""

    HELD = "the values"

    def __init__(self, columns: dict[str, Column]):
        super().__init__(columns)
        self.made: list[Column] = []

    def once(self, column: Column) -> Column:
        self.made.append(column)
        return F.col(self.HELD).getField(f"v{len(self.made) - 1}")

    def held(self, df: DataFrame) -> DataFrame:
        if not self.made:
            return df
        return df.select("*", F.explode(F.array(F.struct(*[x.alias(f"v{i}") for i, x in enumerate(self.made)]))).alias(self.HELD))


# Columns of an alignment that filters read; those that a table lacks are null.
INPUTS = {
    "aligned_sequence": "string", "non_coding_start": "bigint", "non_coding_end": "bigint", "mismatches": "int", "gaps": "int",
    "alignment_string": "string", "query_length": "bigint", "target_length": "bigint", "transposon_start": "bigint",
    "transposon_end": "bigint", "search_space": "bigint",
}
METRICS = {
    "at_content": "double", "gc_content": "double", "entropy": "double", "longest_homopolymer": "int", "dinucleotide_ratio": "double",
    "length": "int", "distance_to_start": "bigint", "distance_to_end": "bigint", "e_value": "double", "p_value": "double",
    "search_space": "bigint", "is_gapped": "boolean", "raw_score": "bigint", "gap_opens": "int", "confidence": "string",
}


def _at_content(c, max_at_percent=75.0) -> Verdict:
    x = c.once(S.at_content(c["aligned_sequence"]))
    return Verdict(x <= max_at_percent, F.format_string(f"AT_CONTENT_TOO_HIGH: %.1f%% > {max_at_percent}%%", x), {"at_content": F.bround(x, 2)})


def _gc_content(c, min_gc_percent=0.0, max_gc_percent=100.0) -> Verdict:
    x = c.once(S.gc_content(c["aligned_sequence"]))
    text = F.format_string(f"GC_CONTENT_OUT_OF_RANGE: %.1f%% not in [{min_gc_percent}, {max_gc_percent}]", x)
    return Verdict((x >= min_gc_percent) & (x <= max_gc_percent), text, {"gc_content": F.bround(x, 2)})


def _entropy(c, min_entropy=1.5) -> Verdict:
    x = c.once(S.shannon_entropy(c["aligned_sequence"]))
    return Verdict(x >= min_entropy, F.format_string(f"LOW_COMPLEXITY: entropy=%.2f < {min_entropy}", x), {"entropy": F.bround(x, 2)})


def _homopolymer(c, max_homopolymer_length=5) -> Verdict:
    x = c.once(S.longest_homopolymer(c["aligned_sequence"]))
    text = F.format_string(f"HOMOPOLYMER_TOO_LONG: %dbp > {max_homopolymer_length}bp", x)
    return Verdict(x <= max_homopolymer_length, text, {"longest_homopolymer": x})


def _dinucleotide(c, max_dinucleotide_ratio=0.8) -> Verdict:
    x = c.once(S.dinucleotide_ratio(c["aligned_sequence"]))
    text = F.format_string(f"DINUCLEOTIDE_REPEAT: %.1f%% > {max_dinucleotide_ratio * 100:.1f}%%", x * 100)
    return Verdict(x <= max_dinucleotide_ratio, text, {"dinucleotide_ratio": F.bround(x, 3)})


def _length_hard_cutoff(c, min_length=9) -> Verdict:
    n = F.length(c["aligned_sequence"])
    return Verdict(n >= min_length, F.format_string(f"TOO_SHORT: %dbp < {min_length}bp", n), {"length": n})


def _length_confidence(c, low_confidence_min=9, high_confidence_min=14) -> Verdict:
    n = F.length(c["aligned_sequence"])
    grade = F.when(n < low_confidence_min, "rejected").when(n < high_confidence_min, "low").otherwise("high")
    text = F.format_string(f"LENGTH_REJECTED: %dbp < {low_confidence_min}bp", n)
    doubt = F.when(grade == "low", F.format_string(f"LOW_CONFIDENCE_LENGTH: %dbp in doubt zone [{low_confidence_min}, {high_confidence_min})", n))
    return Verdict(n >= low_confidence_min, text, {"length": n, "confidence": grade}, grade, doubt)


def _boundary_artifact(c, boundary_distance=10) -> Verdict:
    to_start = F.abs(c["non_coding_start"] - c["transposon_start"])
    to_end = F.abs(c["non_coding_end"] - c["transposon_end"])
    near = F.coalesce(F.least(to_start, to_end) < boundary_distance, F.lit(False))
    text = F.lit("BOUNDARY_ARTIFACT: too close to transposon boundary")
    return Verdict(~near, text, {"distance_to_start": to_start, "distance_to_end": to_end})


def _statistical_significance(
    c, e_value_reject=0.01, e_value_low=1e-3, e_value_high=1e-6, match_score=2, mismatch_penalty=-1, gap_open_penalty=-3,
    gap_extend_penalty=-1, karlin_K=0.1, karlin_lambda=None, search_space=500,
) -> Verdict:
    n = F.length(c["aligned_sequence"])
    q, t = c["query_length"], c["target_length"]
    mism, gaps = F.coalesce(c["mismatches"], F.lit(0)), F.coalesce(c["gaps"], F.lit(0))
    one = F.lit(1).cast("bigint")
    known = q.isNotNull() & t.isNotNull()
    space = F.when(known, F.greatest(one, q - n + 1) * F.greatest(one, t - n + 1)).otherwise(
        F.coalesce(c["search_space"], F.lit(search_space).cast("bigint"))
    )
    gapped = gaps > 0
    opens = S.gap_opens(F.coalesce(c["alignment_string"], F.lit("")))
    score = (n - mism - gaps) * match_score + mism * mismatch_penalty + opens * gap_open_penalty + (gaps - opens) * gap_extend_penalty
    scale = X.scoring_lambda(match_score, mismatch_penalty) if karlin_lambda is None else karlin_lambda
    e = c.once(F.when(gapped, X.gapped_evalue(score, F.coalesce(q, n), F.coalesce(t, space), karlin_K, scale)).otherwise(X.ungapped_evalue(n, mism, space)))
    text = F.concat(F.lit("E_VALUE_TOO_HIGH: E="), _scientific(e), F.lit(f" > {e_value_reject:.2e}"))
    metrics = {
        "e_value": e, "p_value": X.evalue_to_pvalue(e), "search_space": space, "is_gapped": gapped,
        "raw_score": F.when(gapped, score).cast("bigint"), "gap_opens": F.when(gapped, opens),
    }
    doubt = F.when(
        (e > e_value_low) & (e <= e_value_reject),
        F.concat(F.lit("LOW_CONFIDENCE_EVALUE: E="), _scientific(e), F.lit(f" in ({e_value_low:.2e}, {e_value_reject:.2e}]")),
    )
    grade = F.when(e <= e_value_high, "high").otherwise("low")
    metrics["confidence"] = F.when(e > e_value_reject, "rejected").otherwise(grade)
    return Verdict(e <= e_value_reject, text, metrics, grade, doubt)


def _scientific(x: Column) -> Column:
    return F.when(x == X.INFINITY, "inf").otherwise(F.format_string("%.2e", x))


DETAILS = "map<string, struct<passed: boolean, reason: string, metrics: map<string, string>>>"
#: Name to filter; each takes the columns of an alignment and its parameters.
FILTERS: dict[str, Callable[..., Verdict]] = {
    "at_content": _at_content,
    "gc_content": _gc_content,
    "entropy": _entropy,
    "homopolymer": _homopolymer,
    "dinucleotide": _dinucleotide,
    "length_hard_cutoff": _length_hard_cutoff,
    "length_confidence": _length_confidence,
    "boundary_artifact": _boundary_artifact,
    "statistical_significance": _statistical_significance,
}


def default_pipeline() -> Pipeline:
    return (
        Pipeline()
        .add("at_content", Level.COMPOSITION, max_at_percent=75.0)
        .add("entropy", Level.COMPOSITION, min_entropy=1.5)
        .add("homopolymer", Level.COMPOSITION, max_homopolymer_length=5)
        .add("dinucleotide", Level.COMPOSITION, max_dinucleotide_ratio=0.8)
        .add("statistical_significance", Level.LENGTH, e_value_reject=0.01, e_value_low=1e-3, e_value_high=1e-6)
        .add("boundary_artifact", Level.TOPOLOGY, boundary_distance=10)
    )


def _tuned(at: float, entropy: float, run: int, evalues: tuple[float, float, float]) -> Pipeline:
    return (
        default_pipeline()
        .with_params("at_content", max_at_percent=at)
        .with_params("entropy", min_entropy=entropy)
        .with_params("homopolymer", max_homopolymer_length=run)
        .with_params("statistical_significance", **dict(zip(("e_value_reject", "e_value_low", "e_value_high"), evalues)))
    )


def strict_pipeline() -> Pipeline:
    return _tuned(70.0, 1.8, 4, (1e-3, 1e-6, 1e-9))


def relaxed_pipeline() -> Pipeline:
    return _tuned(80.0, 1.2, 6, (0.05, 0.01, 1e-3))


def legacy_pipeline() -> Pipeline:
    """The default with length rules in place of significance."""
    kept = [f for f in default_pipeline().filters if f.name != "statistical_significance"]
    lengths = Pipeline().add("length_hard_cutoff", Level.LENGTH, min_length=9).add("length_confidence", Level.LENGTH, low_confidence_min=9, high_confidence_min=14)
    return Pipeline((*kept[:-1], *lengths.filters, kept[-1]))


def apply_filters(df: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``df`` with the column ``verdict``.

    ``verdict`` has ``pass`` (all enabled filters passed; also if none is enabled), ``confidence``, the arrays
    ``filter_reasons``, ``failed_filters`` and ``passed_filters``, ``metrics`` (a metric that no enabled filter
    gives is null; ``sequence`` and ``length`` always are there) and ``filter_details``: per name of a filter, the last of a
    name, ``passed``, ``reason`` ('' where it passes without doubt) and its ``metrics`` as text. A filter that can't decide, as on a null sequence,
    is in neither array and doesn't fail the row. confidence is 'high' unless a filter that grades it passes with
    another grade; the last one decides. Input columns that ``df`` lacks count as null; a column named ``verdict``
    is replaced, all others stay.
    """
    have = set(df.columns)
    c = Inputs({name: (F.col(name) if name in have else F.lit(None)).cast(kind) for name, kind in INPUTS.items()})
    metrics: dict[str, Column] = {}
    confidence, failed, passed, reasons = F.lit("high"), [], [], []
    details: dict[str, Column] = {}
    for f in pipeline.running():
        v = FILTERS[f.name](c, **f.params)
        metrics |= v.metrics
        ok = F.coalesce(v.passed, F.lit(False))
        failed.append(F.when(~v.passed, F.lit(f.name)))
        passed.append(F.when(v.passed, F.lit(f.name)))
        reasons.append(F.when(~v.passed, v.reason))
        why = F.when(~v.passed, v.reason).otherwise(F.coalesce(v.doubt if v.doubt is not None else F.lit(""), F.lit("")))
        own = F.create_map(*[x for m, c_ in v.metrics.items() for x in (F.lit(m), c_.cast("string"))])
        details[f.name] = F.struct(v.passed.alias("passed"), F.when(v.passed.isNotNull(), why).alias("reason"), own.alias("metrics"))
        if v.confidence is not None:
            confidence = F.when(ok, v.confidence).otherwise(confidence)
    metrics["length"] = F.length(c["aligned_sequence"])
    none = F.array().cast("array<string>")
    made = F.struct(
        F.lit(not failed).alias("pass") if not failed else (F.size(F.array_compact(F.array(*failed))) == 0).alias("pass"),
        confidence.alias("confidence"),
        (F.array_compact(F.array(*reasons)) if reasons else none).alias("filter_reasons"),
        (F.array_compact(F.array(*failed)) if failed else none).alias("failed_filters"),
        (F.array_compact(F.array(*passed)) if passed else none).alias("passed_filters"),
        F.struct(
            c["aligned_sequence"].alias("sequence"), *[metrics.get(m, F.lit(None)).cast(kind).alias(m) for m, kind in METRICS.items()]
        ).alias("metrics"),
        (F.create_map(*[x for name, d in details.items() for x in (F.lit(name), d)]) if details else F.create_map().cast(DETAILS)).alias("filter_details"),
    )
    return c.held(df).withColumn("verdict", made).drop(c.HELD)


def summarise(df: DataFrame, pipeline: Pipeline, *by: str) -> DataFrame:
    """Counts over ``verdict``, per ``by`` or in one row: total, passed, failed, by_high, by_low, by_rejected, and
    ``failed_<name>`` for each enabled filter (0 where none failed)."""
    ok = F.col("verdict.pass")
    grade = F.col("verdict.confidence")
    names = list(dict.fromkeys(f.name for f in pipeline.running()))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (grade == "high")).alias("by_high"),
        F.count_if(ok & (grade == "low")).alias("by_low"),
        F.count_if(~ok).alias("by_rejected"),
        *[F.count_if(F.array_contains("verdict.failed_filters", n)).alias(f"failed_{n}") for n in names],
    )
