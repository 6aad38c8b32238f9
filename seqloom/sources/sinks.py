"""Exports: hit tables, FASTA, annotated feature tables and flat-file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import strand_number

#: The columns of exported hit tables, in order.
PROTEIN_HIT_COLUMNS = (
    "file_basename", "contig_id", "protein_id", "start", "end", "strand", "is_forward", "length", "query_id", "subject_id", "pident",
    "alignment_length", "mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end", "evalue", "bitscore",
    "genomic_sequence",
)
PROFILE_HIT_COLUMNS = (
    "file_basename", "contig_id", "protein_id", "start", "end", "strand", "is_forward", "length", "query_name", "target_name", "evalue",
    "score", "bias", "domain_number", "domain_evalue", "domain_score", "genomic_sequence",
)
_KINDS = {"start": "bigint", "end": "bigint", "strand": "tinyint", "length": "bigint"}


def hit_table(hits: DataFrame, columns: tuple[str, ...] = PROTEIN_HIT_COLUMNS) -> DataFrame:
    """Hits with exactly the given columns, in order; derived ones are made, missing ones are null."""
    made = {"is_forward": F.col("strand") == 1, "length": F.abs(F.col("end") - F.col("start")) + 1}
    have = set(hits.columns)

    def column(name: str) -> Column:
        c = made[name] if name in made else F.col(name) if name in have else F.lit(None).cast("string")
        return (c.cast(_KINDS[name]) if name in _KINDS else c).alias(name)

    return hits.select(*map(column, columns))


def write_csv(hits: DataFrame, path: str, with_sequence: bool = True) -> None:
    """CSV files with a header in the folder ``path``, replacing it; nothing is written if there is no hit."""
    if hits.isEmpty():
        return
    table = hits if with_sequence else hits.drop("genomic_sequence")
    table.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fasta_lines(hits: DataFrame, header: Column, sequence: str = "sequence") -> DataFrame:
    """One text value per hit with a sequence: the header line and the sequence."""
    rows = hits.where(F.length(sequence) > 0)
    return rows.select(F.concat(header, F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(hits: DataFrame, header: Column, path: str, sequence: str = "sequence") -> None:
    fasta_lines(hits, header, sequence).write.mode("overwrite").text(path)


def deduplicated_alignments(alignments: DataFrame, *order: Column) -> DataFrame:
    """The first alignment, by ``order``, of each element's (flank, region start, position, length, orientation)."""
    from seqloom.operators.analytics import best_per_group

    key = ["is_id", "flanking_source", "noncoding_start", "pos2", "length", "orientation"]
    return best_per_group(alignments, key, list(order)).drop("rank")


_FEATURE = "struct<feature_type:string,feature_start:bigint,feature_end:bigint,strand:int,label:string,note:string,translation:string>"


def _feature(kind: str, start: Column, end: Column, strand: Column, label: Column, note: Column, translation: Column | None = None) -> Column:
    text = F.lit(None) if translation is None else F.nullif(translation, F.lit(""))
    made = {"feature_type": F.lit(kind), "feature_start": start.cast("bigint"), "feature_end": end.cast("bigint"), "strand": strand.cast("int"), "label": label, "note": note, "translation": text.cast("string")}
    return F.struct(*[c.alias(n) for n, c in made.items()])


def element_features(elements: DataFrame, alignments: DataFrame, by_length_field: bool = False) -> DataFrame:
    """Annotated features of every element on its own axis: upstream flank, element, downstream flank.

    Args:
        elements: one row per is_id, with the nested columns.
        alignments: deduplicated alignments with ``is_id, flanking_source, noncoding_start, pos1, pos2, length,
            orientation``.
        by_length_field: take the parts' sizes from their length fields, as diagrams do, instead of the sequences.

    Returns:
        ``is_id, feature_type, feature_start, feature_end`` (0-based, half-open), ``strand, label, note,
        translation``. Two flanks (if not empty), the element, its ORFs as CDS, its noncoding regions, and for each
        alignment its places in region and flank as misc_binding. Null parts give no feature.
    """
    parts_of = ("flanking_upstream", "is_element", "flanking_downstream")
    up, own, down = (F.coalesce(F.col(f"{p}.length") if by_length_field else F.length(f"{p}.sequence"), F.lit(0)).cast("bigint") for p in parts_of)
    none, size = F.lit(0), lambda n, what: F.concat(n, F.lit(f"bp {what}"))
    orfs = F.transform(
        F.filter("orf_annotation.orfs", lambda x: x.isNotNull()),
        lambda x: _feature("CDS", up + x["start"] - 1, up + x["end"], strand_number(x["strand"]), F.coalesce(x["orf_id"], F.lit("")), F.concat(F.coalesce(x["length_aa"], none), F.lit("aa")), x["protein_sequence"]),
    )
    regions = F.transform(
        F.filter("orf_annotation.noncoding_regions", lambda x: x.isNotNull()),
        lambda x: _feature("misc_feature", up + x["start"] - 1, up + x["end"], none, F.coalesce(x["type"], F.lit("noncoding")), size(x["end"] - x["start"] + 1, "noncoding region")),
    )
    fixed = F.array_compact(
        F.array(
            F.when(up > 0, _feature("misc_feature", none, up, none, F.lit("upstream_flanking"), size(up, "upstream flanking region"))),
            F.when(down > 0, _feature("misc_feature", up + own, up + own + down, none, F.lit("downstream_flanking"), size(down, "downstream flanking region"))),
            _feature("misc_feature", up, up + own, none, F.col("is_id"), size(own, "IS element")),
        )
    )
    empty = F.array().cast(f"array<{_FEATURE}>")
    parts = elements.select("is_id", F.explode(F.concat(fixed, F.coalesce(orfs, empty), F.coalesce(regions, empty))).alias("f")).select("is_id", "f.*")

    placed = alignments.join(elements.select("is_id", up.alias("up"), own.alias("own"), down.alias("down")), "is_id")
    upstream, n = F.col("flanking_source") == "upstream", F.col("length")
    in_region = F.col("up") + F.col("noncoding_start") - 1 + F.col("pos2")
    in_flank = F.when(upstream, F.col("pos1")).otherwise(F.col("up") + F.col("own") + F.col("pos1"))
    label = lambda end: F.concat(F.lit("aln_"), F.col("flanking_source"), F.lit("_"), n, F.lit(f"bp_{end}"))
    note = F.concat(F.lit("orientation="), F.col("orientation"), F.lit("; flanking_source="), F.col("flanking_source"))
    both = F.array(
        _feature("misc_binding", in_region, in_region + n, none, label("nc"), note),
        F.when(F.when(upstream, F.col("up")).otherwise(F.col("down")) > 0, _feature("misc_binding", in_flank, in_flank + n, none, label("flank"), note)),
    )
    return parts.unionByName(placed.select("is_id", F.explode(F.array_compact(both)).alias("f")).select("is_id", "f.*"))


def arc_features(features: DataFrame) -> DataFrame:
    """Pairs of midpoints that a diagram joins by arcs: each alignment's place in region and flank."""
    half = (F.col("feature_start") + F.col("feature_end")) / 2
    rows = features.where("feature_type = 'misc_binding'").select("is_id", F.regexp_replace("label", "_(nc|flank)$", "").alias("pair"), F.regexp_extract("label", "_(nc|flank)$", 1).alias("side"), half.alias("middle"), "note")
    return rows.groupBy("is_id", "pair", "note").agg(F.sort_array(F.collect_list(F.when(F.col("side") == "nc", F.col("middle")))).alias("region_middles"), F.sort_array(F.collect_list(F.when(F.col("side") == "flank", F.col("middle")))).alias("flank_middles"))


def flat_file(elements: DataFrame, features: DataFrame) -> DataFrame:
    """One annotated flat-file record per element, as text: ``is_id, value``."""
    place = F.concat(F.col("feature_start") + 1, F.lit(".."), F.col("feature_end"))
    place = F.when(F.col("strand") == -1, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    line = F.concat(F.lit("     "), F.rpad("feature_type", 16, " "), place, F.lit('\n                     /label="'), F.col("label"), F.lit('"'))
    rank = F.struct("feature_start", "feature_end", "feature_type", "label", line.alias("line"))
    tables = features.groupBy("is_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["line"]), "\n").alias("table"))
    whole = F.lower(F.concat_ws("", "flanking_upstream.sequence", "is_element.sequence", "flanking_downstream.sequence"))
    rows = elements.select("is_id", whole.alias("whole")).join(tables, "is_id")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.length("whole") - 1) / 60).cast("int"), F.lit(0))),
        lambda i: F.concat(F.lpad(i * 60 + 1, 9, " "), F.lit(" "), F.btrim(F.regexp_replace(F.substring(F.col("whole"), i * 60 + 1, F.lit(60)), "(.{10})", "$1 "))),
    )
    text = F.concat(
        F.lit("LOCUS       "), F.rpad("is_id", 16, " "), F.lit(" "), F.length("whole"), F.lit(" bp    DNA     linear   UNK\nDEFINITION  "), F.col("is_id"),
        F.lit("\nFEATURES             Location/Qualifiers\n"), F.col("table"), F.lit("\nORIGIN\n"), F.array_join(blocks, "\n"), F.lit("\n//"),
    )
    return rows.select("is_id", text.alias("value"))


def write_flat_files(elements: DataFrame, features: DataFrame, path: str) -> DataFrame:
    """One flat file per element, in the folder ``is_id=...`` below ``path``, replacing it.

    Elements that can't be written, those without any letter of sequence, are left out and returned as ``is_id, problem``.
    """
    letters = F.length(F.concat_ws("", *[f"{p}.sequence" for p in ("flanking_upstream", "is_element", "flanking_downstream")]))
    flat_file(elements.where(letters > 0), features).write.mode("overwrite").partitionBy("is_id").text(path)
    return elements.where(letters == 0).select("is_id", F.lit("no sequence").alias("problem"))
