"""Scans of small files of every format, lookups, located hits, regions, exports, a stream."""

import os

import pytest
from pyspark.sql import functions as F

from seqloom.operators import locate as L
from seqloom.operators import positions as P
from seqloom.operators.regions import extract_regions, transposon_record
from seqloom.operators.search import deduplicate_hits, fasta_header
from seqloom.operators.segments import search_words
from seqloom.plans import workflows as W
from seqloom.sources import formats as S
from seqloom.sources import sinks as K
from seqloom.streaming import located as T

FAA = """preamble line
>ctg_1_1 # 3 # 11 # 1 # ID=1
MKV
LLA
>ctg_1_2 # 20 # 28 # -1 # ID=2 > 1
MMM
>ctg_1_1 # 5 # 13 # 1 # again
MK
>bad # x # 2 # 1 # y
AAA
>short
AAA
"""
FNA = ">ctg_1 first contig\nACGTACGTAC\nGTACGTACGTAAACCCGGGTTT\n>ctg_10\nTTTT\n>ctg_1 again\nCCCC\n>none\n"
M8 = "# comment\n\nctg_1_1\tsub one\t90.5\t3\t0\t0\t1\t3\t1\t3\t1e-10\t50\nctg_1_2\ts2\t40\t3\t0\t0\t1\t3\t1\t3\t1e-3\t20\textra\nmissing\ts\t1\t1\t1\t1\t1\t1\t1\t1\t1\t1\nfew\tx\nctg_1_1\ts\tNaNx\t1\t1\t1\t1\t1\t1\t1\t1\t1\n"
GFF = "##gff-version 3\nctg_1\tp\tCDS\t1\t9\t.\t+\t0\tID=1_7;Note=a=b;ID=1_8\nctg_1\tp\tgene\t1\t9\t2.5\t.\t.\tgene_id \"g 1\"; x=1\nctg_1\tp\tCDS\tx\t9\t.\t+\t0\tID=1_9\nctg_1\tp\tCDS\t5\t7\t.\t.\t0\n"
BED = "track name=x\n# c\nchr1\t0\t10\tn\t.\t-\nchr1\t5\t9\nchr1\tx\t9\n"
TBL = "# target\nctg_1_1 - 10 FAM PF1 99 1e-5 30.1 0.1 1 2 1e-4 2e-4 29.0 0.2 1 9 1 9 1 9 0.9 desc\nctg_1_2 acc 10 FAM2 PF1 99 1e-5 30.1 0.1\nctg_1_2 acc 10 FAM3 PF1 99 1e-5 bad 0.1\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    for name, text in (("a.faa", FAA), ("a.fna", FNA), ("a.m8", M8), ("a.gff", GFF), ("a.bed", BED), ("a.tbl", TBL)):
        (at / name).write_text(text)
    return str(at)


def test_fasta(spark, folder):
    rows = S.read_fasta(spark, f"{folder}/a.fna").orderBy("record_rank").collect()
    assert [(r.id, r.description, r.length) for r in rows] == [("ctg_1", "first contig", 32), ("ctg_10", "", 4), ("ctg_1", "again", 4), ("none", "", 0)]
    assert {r.contig_id: r.sequence for r in S.read_contigs(spark, f"{folder}/a.fna").collect()}["ctg_1"] == "CCCC"


def test_genes(spark, folder):
    rows = S.read_gene_proteins(spark, f"{folder}/a.faa").orderBy("record_rank").collect()
    assert [(r.protein_id, r.start, r.end, r.strand, r.sequence) for r in rows] == [("ctg_1_1", 3, 11, 1, "MKVLLA"), ("ctg_1_2", 20, 28, -1, "MMM"), ("ctg_1_1", 5, 13, 1, "MK")]
    genes = S.read_gene_proteins(spark, f"{folder}/a.faa")
    last = {r.protein_id: r.start for r in P.positions_from_genes(genes).collect()}
    first = {r.protein_id: r.start for r in P.positions_from_genes(genes, last=False).collect()}
    assert last["ctg_1_1"] == 5 and first["ctg_1_1"] == 3


def test_features(spark, folder):
    rows = S.read_gff(spark, f"{folder}/a.gff").orderBy("record_rank").collect()
    assert [(r.feature_type, r.start, r.score, r.phase, dict(r.attributes)) for r in rows] == [
        ("CDS", 1, None, 0, {"Note": "a=b", "ID": "1_8"}), ("gene", 1, 2.5, None, {"gene_id": "g 1", "x": "1"}), ("CDS", 5, None, 0, {}),
    ]
    positions = P.positions_from_features(S.read_gff(spark, f"{folder}/a.gff")).collect()
    assert [(r.protein_id, r.strand) for r in positions] == [("ctg_1_8", 1)]
    bed = S.read_bed(spark, f"{folder}/a.bed").orderBy("record_rank").collect()
    assert [(r.start, r.end, r.name, r.score, r.strand) for r in bed] == [(0, 10, "n", None, "-"), (5, 9, None, None, None)]


def test_hits(spark, folder):
    rows = S.read_protein_hits(spark, f"{folder}/a.m8").orderBy("record_rank").collect()
    assert [(r.query_id, r.subject_id, r.file_basename) for r in rows] == [("ctg_1_1", "sub one", "a.m8"), ("ctg_1_2", "s2", "a.m8"), ("missing", "s", "a.m8")]
    found = S.read_profile_hits(spark, f"{folder}/a.tbl").orderBy("record_rank").collect()
    assert [(r.target_name, r.query_name, r.domain_number, r.domain_evalue, r.domain_score) for r in found] == [("ctg_1_1", "FAM", 1, 2e-4, 0.2), ("ctg_1_2", "FAM2", None, None, None)]
    with pytest.raises(Exception, match="CAST|cast"):
        S.parse_hits(spark.createDataFrame([("\t".join(["q", "t", *["x"] * 10]),)], "value string"), strict=True).collect()


def test_located_table(spark, folder, tmp_path):
    found = W.located_hit_table(spark, f"{folder}/a.faa", f"{folder}/a.m8", f"{folder}/a.fna")
    rows = {r.protein_id: r for r in found.collect()}
    assert set(rows) == {"ctg_1_1", "ctg_1_2"} and found.columns == list(K.PROTEIN_HIT_COLUMNS)
    assert rows["ctg_1_1"].genomic_sequence == "ACGTACGTA" and rows["ctg_1_1"].contig_id == "ctg_1"
    assert rows["ctg_1_2"].genomic_sequence == "CCGGGTTTA" and not rows["ctg_1_2"].is_forward
    K.write_csv(found, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    K.write_csv(found.limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")
    genes = P.positions_from_genes(S.read_gene_proteins(spark, f"{folder}/a.faa"))
    assert [r.query_id for r in L.unlocated(S.read_protein_hits(spark, f"{folder}/a.m8"), genes, "query_id").collect()] == ["missing"]


def test_index(spark, folder, tmp_path):
    genes = P.positions_from_genes(S.read_gene_proteins(spark, f"{folder}/a.faa"), last=False)
    index = P.open_index(spark, P.write_index(genes, str(tmp_path / "index")))
    assert P.get_position(index, "ctg_1_2").first().start == 20 and P.get_position(index, "no").first() is None
    assert P.get_positions(index, ["ctg_1_1", "ctg_1_1", "no"]).count() == 1
    assert [r.protein_id for r in P.positions_on_contig(index, "ctg_1").collect()] == ["ctg_1_1", "ctg_1_2"]
    assert tuple(P.index_stats(index).first()) == (2, 1)
    with pytest.raises(Exception):
        P.open_index(spark, str(tmp_path / "nowhere"))


def test_prefix_matches(spark):
    records = spark.createDataFrame([("ctg_1", "AAAA", 1), ("ctg_10", "CCCC", 0), ("x", "", 2)], "id string, sequence string, n int")
    hits = spark.createDataFrame([(1, "ctg_1", 1, 2, 1), (2, "ctg_9", 1, 2, 1), (3, "x", 1, 2, 1), (4, None, 1, 2, 1)], "hit int, contig_id string, start int, end int, strand int")
    first = {r.hit: r.genomic_sequence for r in L.with_genomic_sequence(hits, records, F.col("n")).collect()}
    assert first == {1: "CC", 2: None, 3: None, 4: None}  # the shorter name also fits the longer record, which comes first
    targets = hits.select("hit", F.col("contig_id").alias("target_id"), F.col("start").alias("target_start"), F.col("end").alias("target_end"))
    assert {r.hit: r.sequence for r in L.with_target_sequence(targets, records, F.col("n")).collect()} == {1: "AA", 2: None, 3: "", 4: None}
    assert L.fetch_region(records, "ctg", 1, 3, -1, F.col("n")).first().sequence == "GGG"


def test_regions(spark):
    contigs = spark.createDataFrame([("c", "AACCGGTTAC")], "contig_id string, sequence string")
    rows = [(1, "c", 4, 6, 1), (2, "c", 4, 6, -1), (3, "c", 1, 10, 1), (4, "c", 0, 5, 1), (5, "c", 5, 11, 1), (6, "c", 6, 5, 1), (7, "c", 1, 2, 0), (8, "d", 1, 2, 1), (9, "c", None, 2, 1)]
    genes = spark.createDataFrame(rows, "n int, contig_id string, start bigint, end bigint, strand int")
    found = {r.n: r for r in extract_regions(genes, contigs, 2, 3).collect()}
    assert (found[1].coding.sequence, found[1].upstream.sequence, found[1].downstream.sequence) == ("CGG", "AC", "TTA")
    assert (found[2].coding.sequence, found[2].upstream.sequence, found[2].downstream.sequence) == ("CCG", "AA", "GTT")
    assert (found[3].upstream.start, found[3].upstream.end, found[3].upstream.length, found[3].downstream.length) == (1, 0, 0, 0)
    assert [found[n].problem for n in range(4, 10)] == ["start_below_1", "end_beyond_contig", "start_after_end", "unknown_strand", "unknown_contig", "start_below_1"]
    nested = transposon_record(extract_regions(genes.where("n = 1"), contigs, 2, 3), {"strand": F.lit("over"), "family": F.lit("f")}).first()
    assert nested.sequences.upstream == "AC" and nested.coordinates.coding.end == 6 and (nested.strand, nested.family) == ("over", "f")
    with pytest.raises(Exception, match="bad gene"):
        extract_regions(genes.where("n = 4"), contigs, strict=True).collect()


def test_search(spark, tmp_path):
    rows = [("q", 1, 9.0, "ACGTACGT"), ("q", 2, 8.0, "ACGTACGA"), ("q", 3, 7.0, "TTTTTTTT"), ("q", 4, 10.0, ""), ("e", 1, 1.0, None), ("e", 2, 2.0, ""), ("q", 1, 9.0, "ACGTACGT"), (None, 5, 1.0, "A")]
    hits = spark.createDataFrame(rows, "query_id string, hit_id int, bit_score double, sequence string")
    kept = {(r.query_id, r.hit_id) for r in deduplicate_hits(hits, 0.8).collect()}
    assert kept == {("q", 1), ("q", 3), ("e", 1), ("e", 2), (None, 5)}
    assert deduplicate_hits(hits.limit(0)).count() == 0
    q = spark.createDataFrame([("a", "ACGTTGCAAGCTTACGGA"), ("n", None)], "query_id string, query string")
    t = spark.createDataFrame([("t", "TTTTACGTTGCAAGCTTACGGATT"), ("r", "GGTCCGTAAGCTTGCAACGTGG")], "target_id string, sequence string")
    found = {(r.target_id, r.strand, r.target_start, r.target_end, r.identity) for r in search_words(q, t, 10).collect()}
    assert found == {("t", 1, 5, 22, 1.0), ("r", -1, 3, 20, 1.0)}
    header = fasta_header(F.col("query_id"), identity=F.lit(0.5), evalue=F.lit(1e-3), score=F.col("bit_score"))
    K.write_fasta(hits.where("query_id = 'q'").distinct(), header, str(tmp_path / "fa"))
    assert {r.id for r in S.read_fasta(spark, str(tmp_path / "fa")).collect()} == {"q"}


def test_element_files(spark, tmp_path):
    at = tmp_path / "samples/s1/is_extraction"
    at.mkdir(parents=True)
    (at / "is_elements.json").write_text('[{"is_id": "a", "is_element": {"sequence": "ACGT"}}, {"is_id": "a", "sample": "other"}, {"is_id": "b", "orf_annotation": {"noncoding_regions": [null, {"start": 1}]}}]')
    rows = S.read_elements(spark, str(at / "is_elements.json")).collect()
    assert [r.is_id for r in rows] == ["a", "a", "b"] and rows[2].orf_annotation.noncoding_regions[1].start == 1 and rows[0].flanking_upstream is None
    kept = {r.is_id: r for r in S.read_sample_elements(spark, str(tmp_path / "samples")).collect()}
    assert kept["a"]["sample"] == "s1" and kept["a"].is_element.sequence == "ACGT"
    (tmp_path / "bad.json").write_text('{"is_id": "a"}')
    with pytest.raises(ValueError):
        S.read_elements(spark, str(tmp_path / "bad.json"))
    (tmp_path / "al.json").write_text('{"alignments": [{"is_id": "a", "n": 3}]}')
    assert S.read_annotated_alignments(spark, str(tmp_path / "al.json"), "is_id string, n int").first().n == 3


def test_formats(tmp_path, spark):
    for name, kind in (("x.fa", "fasta"), ("x.GFF3", "gff"), ("x.bed", "bed"), ("x.gtf", "gff")):
        assert S.detect_format(spark, name) == kind
    for text, kind in ((">a\n", "fasta"), ("##gff-version\n", "gff"), ("a\tb\n", "gff"), ("a b\n", "unknown"), ("", "unknown")):
        (tmp_path / "x.txt").write_text(text)
        assert S.detect_format(spark, str(tmp_path / "x.txt")) == kind
    (tmp_path / "g/sub").mkdir(parents=True)
    for name in ("b.fasta", "sub/z.fna", "a.fna", "c.fa", "d.txt"):
        (tmp_path / "g" / name).write_text(">a\nA\n")
    assert [r.file_path.rsplit("/", 1)[1] for r in S.genome_paths(spark, str(tmp_path / "g")).collect()] == ["a.fna", "z.fna", "b.fasta", "c.fa"]


def test_stream(spark, folder, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.m8").write_text(M8)
    genes = P.open_index(spark, P.write_index(P.positions_from_genes(S.read_gene_proteins(spark, f"{folder}/a.faa")), str(tmp_path / "index")))
    for expected in (2, 4):
        stream = T.stream_protein_hits(spark, str(inbox), genes)
        T.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (inbox / "2.m8").write_text(M8)


def test_families(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "is_id string")
    n = spark.createDataFrame([("a", "o1", "IS3"), ("a", "o2", "IS1"), ("a", "o3", "IS3"), ("b", "o1", "")], "is_id string, orf_id string, is_family string")
    assert {r.is_id: r.families for r in W.with_families(c, n).collect()} == {"a": "IS1, IS3", "b": None, "c": None}


def test_parse_files_keeps_every_line(spark, folder):
    out = S.parse_files(spark, f"{folder}/a.m8", "m8").orderBy("line_id.record_rank").collect()
    assert [r.outcome for r in out] == ["skipped", "skipped", "record", "error", "record", "error", "error"]
    assert [r.reason for r in out if r.reason] == ["too_many_fields", "too_few_fields", "not_a_number"]


def test_build_index(spark, folder, tmp_path):
    from seqloom.index import build

    a = P.open_index(spark, build(spark, f"{folder}/a.faa", str(tmp_path / "a")))
    assert {r.protein_id: r.start for r in a.collect()} == {"ctg_1_1": 3, "ctg_1_2": 20}
    b = P.open_index(spark, build(spark, f"{folder}/a.gff", str(tmp_path / "b"), 2))
    assert b.first().protein_id == "ctg_1_8"


def test_listed_regions(spark, folder, tmp_path):
    (tmp_path / "list.csv").write_text("genome_name,protein_id\ng,ctg_1_2\ng,\ng,none\n")
    listed = S.read_protein_list(spark, str(tmp_path / "list.csv"))
    genes = P.positions_from_genes(S.read_gene_proteins(spark, f"{folder}/a.faa"))
    contigs = spark.createDataFrame([("ctg_1", "ACGTACGTACGTACGTACGTAAACCCGGGTTT")], "contig_id string, sequence string")
    found = W.listed_regions(listed, genes, contigs, 5, 5).collect()
    assert [(r.protein_id, r.coding.sequence) for r in found] == [("ctg_1_2", "CCGGGTTTA")]


def test_windows_of_a_stream(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2030, 1, 1, 0, 5), "s", 3.0), (datetime(2030, 1, 1, 0, 50), "s", 9.0), (datetime(2030, 1, 1, 1, 1), "s", 1.0), (datetime(2030, 1, 1, 0, 1), "t", None)]
    spark.createDataFrame(rows, "seen timestamp, subject_id string, bitscore double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seen timestamp, subject_id string, bitscore double").parquet(str(tmp_path / "in"))
    windows = T.hits_per_window(stream, "seen", "1 hour", "10 minutes")
    windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    found = {(r.window.start.hour, r.subject_id, r.n_hits, r.best_bitscore) for r in spark.table("windows").collect()}
    assert found == {(0, "s", 2, 9.0), (1, "s", 1, 1.0), (0, "t", 1, None)}


def test_known_regions(spark):
    contigs = spark.createDataFrame([("test_contig_1", "ATGC" * 250)], "contig_id string, sequence string")
    cases = [(100, 200, 1, 50, 50, (50, 99, 50), (201, 250, 50)), (100, 200, -1, 50, 50, (201, 250, 50), (50, 99, 50)), (1, 100, 1, 500, 50, (1, 0, 0), (101, 150, 50)), (900, 1000, 1, 50, 500, (850, 899, 50), (1001, 1000, 0))]
    for start, end, strand, up, down, expected_up, expected_down in cases:
        genes = spark.createDataFrame([("test_contig_1", start, end, strand)], "contig_id string, start bigint, end bigint, strand int")
        r = extract_regions(genes, contigs, up, down).first()
        assert (r.upstream.start, r.upstream.end, r.upstream.length) == expected_up
        assert (r.downstream.start, r.downstream.end, r.downstream.length) == expected_down
        assert r.coding.length == end - start + 1


def test_one_flat_file_per_element(spark, tmp_path):
    part = "struct<sequence: string, length: int>"
    schema = f"is_id string, flanking_upstream {part}, is_element {part}, flanking_downstream {part}"
    rows = [("a", ("AC", 2), ("GGT", 3), None), ("b", None, ("TTA", 3), ("C", 1)), ("empty", None, ("", 0), None)]
    elements = spark.createDataFrame(rows, schema)
    features = elements.selectExpr("is_id", "'misc_feature' AS feature_type", "0L AS feature_start", "2L AS feature_end", "0 AS strand", "is_id AS label")
    problems = K.write_flat_files(elements, features, str(tmp_path / "out"))
    assert [tuple(r) for r in problems.collect()] == [("empty", "no sequence")]
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("is_id=*/*.txt")}
    assert set(files) == {"is_id=a", "is_id=b"} and "acggt" in files["is_id=a"] and "ttac" in files["is_id=b"]
