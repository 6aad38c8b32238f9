"""Unparsed lines to typed records and located errors, with the grammar of ``grammar`` run inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources.grammar import Line, Reader

SEARCH = "query_id string, subject_id string, pident double, alignment_length bigint, mismatches bigint, gap_opens bigint, query_start bigint, query_end bigint, subject_start bigint, subject_end bigint, evalue double, bitscore double"
FEATURE = "seqid string, source string, feature_type string, start bigint, `end` bigint, score double, strand string, phase int, attributes array<struct<key string, value string>>"
#: The largest whole number of a bigint column; longer ones are a located error of their own.
LARGEST = 2**63 - 1

_INT, _REAL, _TEXT = pa.int64(), pa.float64(), pa.string()
_SEARCH = pa.struct(
    [("query_id", _TEXT), ("subject_id", _TEXT), ("pident", _REAL)]
    + [(n, _INT) for n in ("alignment_length", "mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end")]
    + [("evalue", _REAL), ("bitscore", _REAL)]
)
_FEATURE = pa.struct(
    [("seqid", _TEXT), ("source", _TEXT), ("feature_type", _TEXT), ("start", _INT), ("end", _INT), ("score", _REAL), ("strand", _TEXT), ("phase", pa.int32())]
    + [("attributes", pa.list_(pa.struct([("key", _TEXT), ("value", _TEXT)])))]
)


#: Lines of a file that one block holds, and the most lines that a broken quote spoils.
BLOCK, REACH = 8_192, 64
PARSED = f"outcome string, hit struct<{SEARCH}>, feature struct<{FEATURE}>, reason string, error_line int, error_column int, resumed boolean"
_PARSED = [("outcome", _TEXT), ("hit", _SEARCH), ("feature", _FEATURE), ("reason", _TEXT), ("error_line", pa.int32()), ("error_column", pa.int32()), ("resumed", pa.bool_())]


def parse_lines(
    df: DataFrame, line_id: str, line_format: str, line_text: str, file: str | None = None, line_no: str | None = None, block: int = BLOCK
) -> DataFrame:
    """Every line with what became of it.

    Args:
        df: other columns are ignored, whatever their names.
        file, line_no: the file and the place (whole number) of a line. With both, the lines of a file are read in order, so
            that reading recovers from broken quotes; without, or where one is null, each line is read by itself.
        block: lines of a file that are read together. A block also gets the last REACH lines before it, so the result is the
            same for any block size and partitioning.

    Returns:
        ``line_id`` (type kept), ``line_format``, ``line_text``, ``outcome`` ('record', 'error' or 'skipped'),
        ``hit`` (struct, for m8 records), ``feature`` (struct, for gff records), ``reason``, ``error_line`` and ``error_column``
        (from 1, for errors), ``resumed`` (the anchor at which reading went on after a broken quote). Lines that are null, blank
        or comments are 'skipped'; a line of a null or unknown format is the error 'unknown_format'. A line that is no anchor and
        has a broken quote among the REACH lines before it, without an anchor between, is the error 'after_broken_quote',
        located at that quote. A whole number beyond bigint stays a readable line, but its field is null. An attribute key may
        repeat; all are kept, in order. Lines of one file with equal numbers are read in the order of their ids.
    """
    kind = df.schema[line_id].dataType.simpleString()
    lines = df.select(F.col(line_id).alias("line_id"), F.col(line_format).alias("line_format"), F.col(line_text).alias("line_text"),
                      *[(F.col(c) if c else F.lit(None)).cast(t).alias(n) for c, t, n in ((file, "string", "file"), (line_no, "int", "no"))])
    if file and line_no:
        own = F.floor(F.col("no") / block)
        alone = F.col("file").isNull() | F.col("no").isNull()
        ahead = F.pmod("no", F.lit(block)) >= block - REACH
        blocks = F.when(alone, F.array(F.xxhash64("line_id"))).when(ahead, F.array(own, own + 1)).otherwise(F.array(own))
        lines = lines.select("*", F.posexplode(blocks).alias("is_halo", "block")).repartition("file", "block")
        lines = lines.sortWithinPartitions("file", "block", "no", "line_id")
    else:
        lines = lines.select("*", F.lit(0).alias("is_halo"), F.lit(None).cast("bigint").alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, Reader(REACH)
        for batch in batches:
            out = []
            for fmt, text, name, no, halo, part in zip(*[batch.column(i).to_pylist() for i in range(1, 7)]):
                if name is None or no is None or (name, part) != key:
                    key, reader = (name, part), Reader(REACH)
                made = _described(reader.read(no or 0, text, fmt), fmt) if text is not None else _SKIPPED
                if not halo:
                    out.append(made)
            kept = batch.filter(pc.equal(batch.column(5), 0))
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*out) if out else [[]] * len(_PARSED), _PARSED)]
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], *columns], ["line_id", "line_format", "line_text", *[n for n, _ in _PARSED]])

    return lines.mapInArrow(read, f"line_id {kind}, line_format string, line_text string, {PARSED}")


_SKIPPED = ("skipped", None, None, None, None, None, False)


def _fit(value):
    return None if isinstance(value, int) and value > LARGEST else value


def _described(line: Line, kind: str | None) -> tuple:
    if line.reason:
        return "error", None, None, line.reason, line.line or None, line.column, line.resumed
    if line.fields is None:
        return _SKIPPED
    if kind == "m8":
        return "record", dict(zip([f.name for f in _SEARCH], map(_fit, line.fields))), None, None, None, None, line.resumed
    *plain, attributes = line.fields
    feature = dict(zip([f.name for f in _FEATURE], [*map(_fit, plain), [{"key": k, "value": v} for k, v in attributes]]))
    return "record", None, feature, None, None, None, line.resumed
