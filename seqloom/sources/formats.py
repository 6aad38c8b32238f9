"""Scans of the usual annotation and search files as typed DataFrames, all with built-in text and JSON readers.

Every scan gives ``file_path`` and ``record_rank``, which orders the records of a file; lists of files are read in
the order of their paths. Rows that break the format are dropped, as the formats' own readers do; use
``raw_lines.parse_lines`` to keep them with the reason.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Paths = str | Sequence[str]

_ELEMENT_PART = "sequence string, length int"
ELEMENT_SCHEMA = (
    "is_id string, sample string, seqid string, cluster string, `group` string, "
    f"is_element struct<{_ELEMENT_PART}, contig string, start bigint, `end` bigint, strand string>, "
    f"flanking_upstream struct<{_ELEMENT_PART}, contig_start bigint, contig_end bigint>, "
    f"flanking_downstream struct<{_ELEMENT_PART}, contig_start bigint, contig_end bigint>, "
    "orf_annotation struct<is_id string, is_length int, num_orfs int, num_noncoding_regions int, "
    "noncoding_regions array<struct<start bigint, `end` bigint, length int, type string, sequence string>>, "
    "orfs array<struct<orf_id string, start bigint, `end` bigint, strand string, length_aa int, protein_sequence string>>>"
)
SEARCH_FIELDS = (
    ("query_id", "string"), ("subject_id", "string"), ("pident", "double"), ("alignment_length", "int"), ("mismatches", "int"),
    ("gap_opens", "int"), ("query_start", "int"), ("query_end", "int"), ("subject_start", "int"), ("subject_end", "int"),
    ("evalue", "double"), ("bitscore", "double"),
)


def _ranked(reader, paths: Paths, separator: str | None = None) -> DataFrame:
    if separator:
        reader = reader.option("lineSep", separator)
    lines = reader.text(list(paths) if not isinstance(paths, str) else paths)
    # Within a file the blocks are in order, and within a block the ids are.
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("record_rank"),
    )


def _try(kind: str, c: Column) -> Column:
    return F.btrim(c).try_cast(kind)


def _with_parts(lines: DataFrame, line: Column, separator: str) -> DataFrame:
    """``lines`` with the array ``the parts``, split once: an optimizer may repeat a projection's work in every filter
    and field above it, but not a generator's."""
    return lines.select("*", F.explode(F.array(F.split(line, separator))).alias("the parts"))


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    return _ranked(spark.read, paths)


def _records(spark: SparkSession, paths: Paths) -> DataFrame:
    """FASTA records: ``header`` and ``body``. Only a '>' that begins a line begins a record; text before is left out."""
    raw = _ranked(spark.read, paths, "\n>")
    # One row a file: its first piece, which alone still has its '>' or comes before any record.
    first = raw.groupBy("file_path").agg(F.min("record_rank").alias("record_rank")).withColumn("first", F.lit(True))
    raw = raw.join(F.broadcast(first), ["file_path", "record_rank"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    raw = raw.where(~F.col("first") | F.col("value").startswith(">"))
    raw = raw.withColumn("text", F.when(F.col("first"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    body = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    return raw.select("file_path", "record_rank", F.btrim(F.substring_index("text", "\n", 1), F.lit(" \t\r\n")).alias("header"), body.alias("body"))


def _sequence(body: str = "body") -> Column:
    return F.regexp_replace(body, r"\s", "")


def read_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """``header, id, description, sequence, length`` of every record, duplicates kept. A header alone has ''."""
    rows = _records(spark, paths).withColumn("sequence", _sequence())
    return rows.select(
        "file_path", "record_rank", "header",
        F.regexp_extract("header", r"^(\S*)", 1).alias("id"),
        F.regexp_extract("header", r"^\S*\s+(.*)$", 1).alias("description"),
        "sequence", F.length("sequence").alias("length"),
    )


def read_contigs(spark: SparkSession, paths: Paths) -> DataFrame:
    """``contig_id, sequence``, one row per id: the last record of an id counts."""
    return keep_one(read_fasta(spark, paths), "id", last=True).select(F.col("id").alias("contig_id"), "sequence")


def keep_one(df: DataFrame, key: str, last: bool) -> DataFrame:
    """The first or last record of every key by file path and place in the file; map-side combined."""
    others = [c for c in df.columns if c != key]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), F.struct("file_path", "record_rank"))
    return df.groupBy(key).agg(pick.alias("kept")).select(key, "kept.*")


def gene_fields(header: Column) -> list[Column]:
    """Id and limits from a gene caller's header ``id # start # end # strand # ...``; null where a part is missing."""
    part = F.split(header, "#")
    enough = F.size(part) >= 4
    number = lambda i, kind: F.when(enough, _try(kind, F.get(part, F.lit(i))))
    identity = F.regexp_extract(F.get(part, F.lit(0)), r"^\s*(\S+)", 1)
    return [
        identity.alias("protein_id"), number(1, "bigint").alias("start"), number(2, "bigint").alias("end"), number(3, "tinyint").alias("strand")
    ]


def read_gene_proteins(spark: SparkSession, paths: Paths) -> DataFrame:
    """A gene caller's protein FASTA: ``protein_id, start, end, strand, sequence``; records with a bad header dropped."""
    rows = _records(spark, paths).select("file_path", "record_rank", *gene_fields(F.col("header")), _sequence().alias("sequence"))
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("strand").isNotNull() & (F.col("protein_id") != ""))


def attribute_map(text: Column) -> Column:
    """The attribute column as a map: ``key=value`` split at the first '=', else ``key "value"``; the later key wins."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda x: F.btrim(x)), lambda x: x != "")

    def entry(x: Column) -> Column:
        plain = F.instr(x, "=") > 0
        old = F.regexp_extract(x, r"^(\S+)\s+(.*)$", 1)
        key = F.when(plain, F.btrim(F.substring_index(x, "=", 1))).otherwise(old)
        value = F.when(plain, F.btrim(F.regexp_replace(x, r"^[^=]*=", ""))).otherwise(F.btrim(F.regexp_extract(x, r"^(\S+)\s+(.*)$", 2), F.lit('" ')))
        return F.struct(key.alias("key"), value.alias("value"))

    entries = F.filter(F.transform(pairs, entry), lambda e: e["key"] != "")
    later = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(later)


def parse_features(lines: DataFrame) -> DataFrame:
    """GFF features from lines in ``value``: at least eight fields and good numbers; '#' and blank lines left out."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = _with_parts(lines.where((line != "") & ~line.startswith("#")), F.regexp_replace("value", r"\s+$", ""), "\t")
    part = F.col("the parts")
    get = lambda i: F.get(part, F.lit(i))
    dotted = lambda i, kind: F.when(get(i) != ".", _try(kind, get(i)))
    bad = ((get(5) != ".") & dotted(5, "double").isNull()) | ((get(7) != ".") & dotted(7, "int").isNull())
    rows = rows.where((F.size(part) >= 8) & _try("bigint", get(3)).isNotNull() & _try("bigint", get(4)).isNotNull() & ~bad)
    return rows.select(
        *[c for c in lines.columns if c != "value"], get(0).alias("seqid"), get(1).alias("source"), get(2).alias("feature_type"),
        _try("bigint", get(3)).alias("start"), _try("bigint", get(4)).alias("end"), dotted(5, "double").alias("score"), get(6).alias("strand"),
        dotted(7, "int").alias("phase"), attribute_map(F.coalesce(get(8), F.lit(""))).alias("attributes"),
    )


def read_gff(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_features(read_lines(spark, paths))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED records: 0-based start, end not included; name, score and strand may be missing; 'track' lines left out."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = _with_parts(lines.where((line != "") & ~line.startswith("#") & ~line.startswith("track")), line, "\t")
    get = lambda i: F.get("the parts", F.lit(i))
    rows = rows.where(_try("bigint", get(1)).isNotNull() & _try("bigint", get(2)).isNotNull())
    return rows.select(
        *[c for c in lines.columns if c != "value"], get(0).alias("chrom"), _try("bigint", get(1)).alias("start"), _try("bigint", get(2)).alias("end"),
        get(3).alias("name"), F.when(get(4) != ".", _try("int", get(4))).alias("score"), get(5).alias("strand"),
    )


def read_bed(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_bed(read_lines(spark, paths))


def parse_hits(lines: DataFrame, strict: bool = False, comments: bool = True) -> DataFrame:
    """Tabular search hits: twelve or more tab fields. Bad rows are dropped; with ``strict`` a bad number is an error."""
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = lines.where(line != "")
    if comments:
        rows = rows.where(~line.startswith("#"))
    rows = _with_parts(rows, line, "\t").where(F.size("the parts") >= 12)
    get = lambda i: F.get("the parts", F.lit(i))
    fields = [(get(i) if kind == "string" else F.btrim(get(i)).cast(kind) if strict else _try(kind, get(i))).alias(name) for i, (name, kind) in enumerate(SEARCH_FIELDS)]
    made = rows.select(*[c for c in lines.columns if c != "value"], *fields)
    numbers = [] if strict else [name for name, kind in SEARCH_FIELDS if kind != "string"]
    return made.dropna(subset=numbers) if numbers else made


def read_protein_hits(spark: SparkSession, paths: Paths) -> DataFrame:
    base = F.element_at(F.split("file_path", "/"), -1)
    return parse_hits(read_lines(spark, paths)).withColumn("file_basename", base)


def read_search_hits(spark: SparkSession, paths: Paths) -> DataFrame:
    """Nucleotide search hits; bad numbers are errors, comments aren't known."""
    names = {"query_id": "query_id", "subject_id": "target_id", "pident": "identity", "bitscore": "bit_score", "subject_start": "target_start", "subject_end": "target_end"}
    return parse_hits(read_lines(spark, paths), strict=True, comments=False).withColumnsRenamed(names)


def parse_profile_hits(lines: DataFrame) -> DataFrame:
    """Profile hits from white-space separated lines of nine or more fields.

    target_name, query_name, accession, evalue, score and bias are fields 1, 4, 2, 7, 8 and 9. With 19 or more fields
    domain_number, domain_evalue and domain_score are fields 10, 13 and 15; from the first that is no number on
    they are null.
    """
    line = F.btrim("value", F.lit(" \t\r\n"))
    rows = _with_parts(lines.where((line != "") & ~line.startswith("#")), line, r"\s+").where(F.size("the parts") >= 9)
    get = lambda i: F.get("the parts", F.lit(i))
    many = F.size("the parts") >= 19
    number = F.when(many, _try("int", get(9)))
    evalue = F.when(number.isNotNull(), _try("double", get(12)))
    score = F.when(evalue.isNotNull(), _try("double", get(14)))
    made = rows.select(
        *[c for c in lines.columns if c != "value"], get(0).alias("target_name"), get(3).alias("query_name"), get(1).alias("accession"),
        _try("double", get(6)).alias("evalue"), _try("double", get(7)).alias("score"), _try("double", get(8)).alias("bias"),
        number.alias("domain_number"), evalue.alias("domain_evalue"), score.alias("domain_score"),
    )
    return made.where(F.col("evalue").isNotNull() & F.col("score").isNotNull() & F.col("bias").isNotNull())


def read_profile_hits(spark: SparkSession, paths: Paths) -> DataFrame:
    base = F.element_at(F.split("file_path", "/"), -1)
    return parse_profile_hits(read_lines(spark, paths)).withColumn("file_basename", base)


def read_elements(spark: SparkSession, paths: Paths) -> DataFrame:
    """Element records from JSON arrays; missing keys are null. Files that aren't arrays raise an error when read."""
    names = list(paths) if not isinstance(paths, str) else [paths]
    lines = _ranked(spark.read, names).where(F.btrim("value") != "")
    begins = lines.groupBy("file_path").agg(F.min_by(F.left(F.ltrim("value"), F.lit(1)), "record_rank").alias("first"))
    if not begins.where(F.col("first") != "[").isEmpty():
        raise ValueError("an element file must hold a JSON array")
    return spark.read.schema(ELEMENT_SCHEMA).option("multiLine", True).json(names).withColumn("file_path", F.col("_metadata.file_path"))


def read_sample_elements(spark: SparkSession, samples_dir: str, samples: Sequence[str] | None = None) -> DataFrame:
    """Element records of all samples, or only of the named ones, whose files alone are then read, under
    ``<samples_dir>/<sample>/is_extraction/is_elements.json``; the first record of each (sample, is_id)."""
    rows = read_elements(spark, [f"{samples_dir}/{name}/is_extraction/is_elements.json" for name in (["*"] if samples is None else samples)])
    folder = F.regexp_extract("file_path", r"([^/]+)/is_extraction/[^/]+$", 1)
    rows = rows.withColumns({"sample": folder, "place": F.monotonically_increasing_id()})
    others = [c for c in rows.columns if c not in ("sample", "is_id", "place")]
    kept = rows.groupBy("sample", "is_id").agg(F.min_by(F.struct(*others), "place").alias("x"))
    return kept.select("sample", "is_id", "x.*")


def read_annotated_alignments(spark: SparkSession, paths: Paths, schema: str | T.StructType) -> DataFrame:
    """The ``alignments`` arrays of JSON documents, one row per alignment of the given schema."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    outer = T.StructType([T.StructField("alignments", T.ArrayType(kind))])
    rows = spark.read.schema(outer).option("multiLine", True).json(list(paths) if not isinstance(paths, str) else paths)
    return rows.select(F.explode("alignments").alias("a")).select("a.*")


def genome_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``file_path`` of the FASTA files below a folder, in the order in which they are to be read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{fna,fasta,fa}").load(folder)
    kind = F.element_at(F.split("path", r"\."), -1)
    order = F.when(kind == "fna", 0).when(kind == "fasta", 1).otherwise(2)
    return found.select(F.col("path").alias("file_path"), order.alias("kind_rank")).orderBy("kind_rank", "file_path")


#: Extensions of the formats.
EXTENSIONS = {
    "fasta": ("fasta", "fa", "fna", "faa", "ffn"),
    "gff": ("gff", "gff3", "gtf"),
    "bed": ("bed",),
}


def detect_format(spark: SparkSession, path: str) -> str:
    """'fasta', 'gff', 'bed' or 'unknown', by the extension, else by the first line; a path that Spark can read."""
    suffix = os.path.splitext(path)[1].lower().lstrip(".")
    for kind, endings in EXTENSIONS.items():
        if suffix in endings:
            return kind
    line = spark.read.text(path).first()
    return format_of_line(line["value"] if line else "")


def format_of_line(line: str) -> str:
    if line.startswith(">"):
        return "fasta"
    return "gff" if re.match("##gff", line) or "\t" in line else "unknown"


def read_protein_list(spark: SparkSession, paths: Paths, schema: str = "genome_name string, protein_id string") -> DataFrame:
    """A CSV list of proteins with a header; rows without a protein_id are left out."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(list(paths) if not isinstance(paths, str) else paths)
    return rows.where(F.length(F.btrim("protein_id")) > 0)


def read_hit_table(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV hit table, with types inferred from its values."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def parse_files(spark: SparkSession, paths: Paths, kind: str) -> DataFrame:
    """Files of search ('m8') or feature ('gff') lines with what became of every line, as in ``raw_lines.parse_lines``.

    Lines are numbered from 1 in their file, from the counts of its splits, so that reading recovers from broken quotes.
    """
    from seqloom.sources.raw_lines import parse_lines

    lines = read_lines(spark, paths)
    split = ["file_path", F.col("record_rank.block").alias("block")]
    sizes = lines.groupBy(*split).agg(F.min("record_rank.row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file_path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.select(*split, "record_rank", "value").join(sizes, ["file_path", "block"])
    number = (F.col("record_rank.row") - F.col("first") + F.col("before") + 1).cast("int")
    rows = numbered.select("file_path", number.alias("no"), F.struct("file_path", "record_rank").alias("place"), F.lit(kind).alias("kind"), "value")
    return parse_lines(rows, "place", "kind", "value", "file_path", "no")
