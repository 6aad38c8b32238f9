"""Command: python -m seqloom.index INPUT OUTPUT builds a position index from a gene FASTA or a .gff file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from seqloom.operators import positions
from seqloom.sources import formats


def build(spark: SparkSession, source: str, target: str, partitions: int | None = None) -> str:
    """The first row of a repeated id counts; an index that is there is replaced."""
    if source.lower().endswith((".gff", ".gff3")):
        table = positions.positions_from_features(formats.read_gff(spark, source))
    else:
        table = positions.positions_from_genes(formats.read_gene_proteins(spark, source), last=False)
    return positions.write_index(table, target, partitions)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--partitions", type=int)
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(build(spark, args.input, args.output or f"{args.input}.index", args.partitions))


if __name__ == "__main__":
    main()
