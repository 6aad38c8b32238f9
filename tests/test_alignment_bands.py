"""Quality bands, identity and counts of alignments."""

import os
from collections import Counter

import pytest

from seqloom.operators.alignments import Finder
from seqloom.operators.analytics import with_alignment_columns
from seqloom.operators.elements import element_alignments
from seqloom.queries.elements import QUERIES, _elements

SMALL = "/root/testdata/sf0.001"


def test_bands(spark):
    rows = [(12, 0), (11, 0), (9, 1), (8, 0), (15, 1), (16, 1), (15, 2), (20, 0)]
    found = with_alignment_columns(spark.createDataFrame(rows, "length int, mismatches int")).collect()
    assert [(r.is_exact, r.is_short) for r in found] == [(True, True), (False, True), (False, True), (False, False), (False, True), (False, False), (False, False), (True, False)]
    assert found[4].identity == pytest.approx(14 / 15)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_counts(spark):
    elements = _elements(spark, SMALL)
    first = {}
    for r in sorted(element_alignments(elements, Finder(min_length=14, max_mismatches=2)).collect(), key=lambda r: (r.region_index, r.pos1)):
        first.setdefault((r.is_id, r.flanking_source, r.noncoding_start, r.pos2, r.length, r.orientation), r)
    counted = Counter(k[0] for k in first)
    rows = QUERIES["alignment_counts"](spark, SMALL).collect()
    assert {r.is_id: r.n for r in rows} == {r.is_id: counted[r.is_id] for r in elements.collect()} and first
    assert sum(r.n_exact for r in rows) == sum(r.mismatches == 0 and r.length >= 12 for r in first.values())
    described = {r.column: r for r in QUERIES["alignment_description"](spark, SMALL).collect()}
    assert described["identity"].n == len(first) and described["length"].max == max(r.length for r in first.values())
