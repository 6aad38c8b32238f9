"""Significance of alignments as column expressions; scoring constants are worked out once, on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def ungapped_evalue(length: Column, mismatches: Column, search_space: Column) -> Column:
    """Expected chance matches of ``length`` letters with exactly that many mismatches; infinite where impossible."""
    choose = F.aggregate(
        F.when(mismatches > 0, F.sequence(F.lit(1), mismatches.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda total, i: total + F.log((length - mismatches + i) / i),
    )
    log_e = F.log(search_space.cast("double")) + choose + mismatches * math.log(3) - length * math.log(4)
    impossible = (mismatches > length) | (mismatches < 0) | (length <= 0)
    return F.when(impossible, F.lit(INFINITY)).otherwise(F.exp(log_e))


def gapped_evalue(score: Column, query_length: Column, target_length: Column, k: float = 0.1, scale: float | None = None) -> Column:
    """Expected chance alignments of at least that score; infinite for scores not above 0."""
    scale = scoring_lambda() if scale is None else scale
    log_e = math.log(k) + F.log(query_length.cast("double")) + F.log(target_length.cast("double")) - score * scale
    return F.when(score <= 0, F.lit(INFINITY)).otherwise(F.exp(log_e))


def scoring_lambda(match: float = 2, mismatch: float = -1) -> float:
    """The positive root of e^(match x) / 4 + 3 e^(mismatch x) / 4 = 1, by bisection; for (2, -1) 0.264497."""
    if match <= 0 or mismatch >= 0 or match + 3 * mismatch >= 0:
        raise ValueError("scores must have a positive match and a negative mean")
    value = lambda x: math.exp(match * x) / 4 + 3 * math.exp(mismatch * x) / 4 - 1
    low, high = 1e-9, 1.0
    while value(high) < 0:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return (low + high) / 2


def evalue_to_pvalue(evalue: Column) -> Column:
    return F.when(evalue >= 700, 1.0).otherwise(1 - F.exp(-evalue))
