"""Lines of search and feature files: what is readable, where the error is, and how reading resumes."""

import random

import pytest

from seqloom.sources.grammar import Malformed, Reader, read_line
from seqloom.sources.raw_lines import parse_lines

M8 = ["q_1", "s one", "98.5", "100", "1", "0", "1", "100", "5", "104", "1e-30", "200.5"]
GFF = ["ctg", "tool", "CDS", "1", "90", ".", "+", "0", "ID=1_1;Note=a b"]


def line(fields, **change):
    own = list(fields)
    for i, v in change.items():
        own[int(i[1:]) - 1] = v
    return "\t".join(own)


@pytest.mark.parametrize("text", [
    line(M8), line(M8) + "\r", line(M8, f2='"a\tb ""c"""'), line(M8, f2='a"b'), line(M8, f4='"100"'), line(M8, f3="0"), line(M8, f3="100.000"),
    line(M8, f11="0.0"), line(M8, f11="-0.0"), line(M8, f12="1E+3"), line(M8, f1='"q"'),
])
def test_readable_search_lines(text):
    assert len(read_line(text, "m8")) == 12


@pytest.mark.parametrize("text,reason,column", [
    (line(M8)[:20], "too_few_fields", 21), (line(M8) + "\tx", "too_many_fields", 48), (line(M8, f1=""), "empty_field", 1), (line(M8, f2=""), "empty_field", 5),
    (line(M8, f1="q 1"), "space_in_id", 1), (line(M8, f2='"open'), "quote_not_closed", 5), (line(M8, f2='"a"b'), "text_after_quote", 8),
    (line(M8, f3="100.01"), "above_100", 11), (line(M8, f3="-1"), "below_zero", 11), (line(M8, f4="+7"), "not_a_whole_number", 16), (line(M8, f4=" 7"), "not_a_whole_number", 16),
    (line(M8, f11="1e"), "not_a_number", 36), (line(M8, f12="-1e-400"), "below_zero", 42), (line(M8, f12="inf"), "not_a_number", 42), (line(M8, f3="1."), "not_a_number", 11),
    (line(M8, f4="٣"), "not_a_whole_number", 16), (line(M8) + "\r\r", "not_a_number", 42),
])
def test_unreadable_search_lines(text, reason, column):
    with pytest.raises(Malformed) as e:
        read_line(text, "m8")
    assert (e.value.reason, e.value.column) == (reason, column)


@pytest.mark.parametrize("text", [
    line(GFF), line(GFF, f9="."), line(GFF, f9='gene "a;b" ; ;x=1;'), line(GFF, f9='ID=a "b;c" d'), line(GFF, f6="-1.5e3", f8="."), line(GFF, f9="k=v=w"), line(GFF, f7="?"),
])
def test_readable_feature_lines(text):
    assert len(read_line(text, "gff")) == 9


@pytest.mark.parametrize("text,reason", [
    (line(GFF, f3=""), "empty_field"), (line(GFF, f4="0"), "start_below_1"), (line(GFF, f4="91"), "start_after_end"), (line(GFF, f6=""), "not_a_number"),
    (line(GFF, f7="*"), "unknown_strand"), (line(GFF, f8="3"), "unknown_phase"), (line(GFF, f9=""), "no_attribute"), (line(GFF, f9=" ; "), "no_attribute"),
    (line(GFF, f9="ID="), "no_attribute_value"), (line(GFF, f9="=x"), "no_attribute_key"), (line(GFF, f9='Note="a'), "quote_not_closed"), (line(GFF, f9='a "b" c'), "text_after_quote"),
    (line(GFF, f9="word"), "not_an_attribute"), (line(GFF, f9='a"b"'), "not_an_attribute"), (line(GFF) + "\t", "too_many_fields"), (line(GFF[:8]), "too_few_fields"), (line(GFF, f4="+1"), "not_a_whole_number"),
])
def test_unreadable_feature_lines(text, reason):
    with pytest.raises(Malformed) as e:
        read_line(text, "gff")
    assert e.value.reason == reason


def test_neither():
    for text in ("", "   ", "\t\t", "#comment", "# q\t", "\r"):
        assert read_line(text, "m8") is None


def test_attributes_keep_order_and_repeats():
    assert read_line(line(GFF, f9='a=1; b "2;3";a=4'), "gff")[8] == [("a", "1"), ("b", "2;3"), ("a", "4")]


def test_reading_resumes_at_an_anchor_after_a_broken_quote():
    reader = Reader(4)
    tabbed = line(M8, f2='"a\tb"')  # readable, so an anchor
    texts = [line(M8), line(M8, f2='"open'), 'tail of it"\tx', "# note", "", tabbed, line(M8), line(M8, f2='"open')] + ["x"] * 6 + [line(M8)]
    lines = [reader.read(n, text, "m8") for n, text in enumerate(texts, 1)]
    spoiled = "after_broken_quote"
    assert [x.reason for x in lines] == [None, "quote_not_closed", spoiled, None, None, None, None, "quote_not_closed", *[spoiled] * 4, *["too_few_fields"] * 2, None]
    assert [x.line for x in lines if x.reason] == [2, 2, 8, 8, 8, 8, 8, 13, 14]
    assert [n for n, x in enumerate(lines, 1) if x.resumed] == [6]
    assert [n for n, x in enumerate(lines, 1) if x.fields] == [1, 6, 7, 15]


def test_recovery_is_the_same_for_any_partitioning(spark):
    """Files of records, broken quotes, tails, comments and junk; blocks of 100 lines and one of all."""
    draw = random.Random(2)
    kinds = [line(M8), line(M8, f2='"open'), 'tail" of\tit', "# note", "", "junk", line(M8, f3="x"), line(M8, f12='"5"x')]
    rows = [(f * 1000 + n, f"f{f}", n, draw.choices(kinds, [6, 1, 2, 1, 1, 2, 1, 1])[0], "m8") for f in range(3) for n in range(1, 400)]
    rows += [(9001, None, 5, line(M8, f2='"open'), "m8"), (9002, None, 6, "junk", "m8"), (9003, "f1", None, "junk", "m8")]
    df = spark.createDataFrame(rows, "raw_id bigint, name string, n int, text string, kind string")
    expected = {}
    for f in range(3):
        reader = Reader(64)
        for i, name, n, text, kind in rows:
            if name == f"f{f}" and n is not None:
                x = reader.read(n, text, kind)
                expected[i] = (x.reason, x.line, x.column, x.resumed)
    for parts, block in ((1, 100), (2, 8_192), (7, 130)):
        out = parse_lines(df.repartition(parts), "raw_id", "kind", "text", "name", "n", block).collect()
        found = {r.line_id: (r.reason, r.error_line, r.error_column, r.resumed) for r in out}
        assert len(out) == len(rows) and {i: found[i] for i in expected} == expected
        assert found[9002][0] == found[9003][0] == "too_few_fields"
    assert {"after_broken_quote", "quote_not_closed", "text_after_quote"} <= {x[0] for x in expected.values()}
    # What is spoiled is unreadable by itself, too.
    alone = {r.line_id for r in parse_lines(df, "raw_id", "kind", "text").collect() if r.outcome == "error"}
    assert alone == {i for i, x in found.items() if x[0]}


def test_parse_lines(spark):
    rows = [(1, "m8", line(M8), "clash"), (2, "gff", line(GFF), ""), (3, "m8", "bad", ""), (4, "m8", None, ""), (5, None, "x", ""), (6, "bam", "x", ""), (7, "gff", "", ""), (8, "m8", line(M8, f4="9" * 30), ""), (1, "m8", line(M8), "copy")]
    out = parse_lines(spark.createDataFrame(rows, "raw_id bigint, kind string, text string, outcome string"), "raw_id", "kind", "text").collect()
    by = {}
    for r in out:
        by.setdefault(r.line_id, []).append(r)
    assert [(r.outcome, r.hit.pident, r.hit.subject_id) for r in by[1]] == [("record", 98.5, "s one")] * 2
    assert by[2][0].feature.attributes[0].key == "ID" and by[2][0].feature.score is None
    assert (by[3][0].outcome, by[3][0].reason) == ("error", "too_few_fields")
    assert by[4][0].outcome == by[7][0].outcome == "skipped"
    assert by[5][0].reason == by[6][0].reason == "unknown_format"
    assert by[8][0].outcome == "record" and by[8][0].hit.alignment_length is None
    assert parse_lines(spark.createDataFrame(rows, "raw_id bigint, kind string, text string, outcome string").limit(0), "raw_id", "kind", "text").count() == 0
