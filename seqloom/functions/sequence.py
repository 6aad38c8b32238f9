"""Column functions on sequence strings. All stay inside the JVM; a null argument gives null unless said otherwise."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the nucleotide codes, in both cases; N, W, S and other letters stay as they are.
PLAIN = "ACGTacgtRYMKrymkBVDHbvdh"
COMPLEMENT = "TGCAtgcaYRKMyrkmVBHDvbhd"
BASES = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), PLAIN, COMPLEMENT))


def to_dna(seq: Column | str) -> Column:
    """U and u as T and t."""
    return F.translate(_c(seq), "Uu", "Tt")


def _share_of(seq: Column | str, letters: str) -> Column:
    s = F.upper(_c(seq))
    kept = F.length(s) - F.length(F.translate(s, letters, ""))
    return F.when(F.length(s) == 0, 0.0).otherwise(F.lit(100.0) * kept / F.length(s))


def at_content(seq: Column | str) -> Column:
    """Per cent of A and T; 0 for an empty sequence."""
    return _share_of(seq, "AT")


def gc_content(seq: Column | str) -> Column:
    """Per cent of G and C; 0 for an empty sequence."""
    return _share_of(seq, "GC")


def shannon_entropy(seq: Column | str) -> Column:
    """Entropy in bits over all symbols that occur, case folded; 0 for an empty sequence."""
    s = F.upper(_c(seq))
    n = F.length(s)

    def add(total: Column, symbol: Column) -> Column:
        p = (n - F.length(F.replace(s, symbol))) / n
        return total - p * F.log2(p)

    symbols = F.array_distinct(F.split(s, ""))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(symbols, F.lit(0.0), add))


def longest_homopolymer(seq: Column | str) -> Column:
    """Length of the longest run of one of A, C, G, T; 0 if there is none."""
    s = F.upper(_c(seq))
    runs = F.transform(F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+)"), F.lit(1)), F.length)
    return F.when(s.isNotNull(), F.coalesce(F.array_max(runs), F.lit(0)))


def has_homopolymer(seq: Column | str, min_length: int = 5) -> Column:
    return F.upper(_c(seq)).rlike("|".join(f"{b}{{{min_length}}}" for b in "ATGC"))


def dinucleotide_ratio(seq: Column | str) -> Column:
    """The largest share of positions at which one of the 12 pairs of different bases begins; 0 below two letters."""
    s = F.upper(_c(seq))
    counts = [F.regexp_count(s, F.lit(f"(?={a}{b})")) for a, b in permutations(BASES, 2)]
    return F.when(F.length(s) < 2, 0.0).otherwise(F.greatest(*counts) / (F.length(s) - 1))


def has_dinucleotide_repeat(seq: Column | str, threshold: float = 0.8) -> Column:
    """Whether that ratio reaches the threshold; false below six letters."""
    return (F.length(_c(seq)) >= 6) & (dinucleotide_ratio(seq) >= threshold)


def gap_opens(marks: Column | str) -> Column:
    """The number of maximal runs of spaces in an alignment's marker line."""
    return F.regexp_count(_c(marks), F.lit(" +"))


def sequence_identity(a: Column | str, b: Column | str) -> Column:
    """Matching positions, case folded, over the longer length; 0 if either is empty."""
    x, y = F.upper(_c(a)), F.upper(_c(b))
    same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, 1).otherwise(0))
    total = F.aggregate(same, F.lit(0), lambda n, hit: n + F.coalesce(hit, F.lit(0)))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(total / longer)


def mismatch_positions(a: Column | str, b: Column | str) -> Column:
    """Places (from 0) at which two sequences differ; an error if their lengths do. N equals only N."""
    x, y = _c(a), _c(b)
    at = F.filter(
        F.transform(F.split(x, ""), lambda base, i: F.when(base != F.substring(y, i + 1, F.lit(1)), i)), lambda i: i.isNotNull()
    )
    none = F.array().cast("array<int>")
    return (
        F.when(F.length(x) != F.length(y), F.raise_error("sequences differ in length"))
        .when(x == y, none)
        .otherwise(at)
    )


def mismatches(a: Column | str, b: Column | str) -> Column:
    return F.size(mismatch_positions(a, b))


def regions_overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Whether two half-open ranges share a position."""
    return ~((end1 <= start2) | (end2 <= start1))


def slice_region(seq: Column | str, start: Column | str, end: Column | str, strand: Column | str) -> Column:
    """Bases start..end (from 1, both included, clipped to the sequence); reverse complement on strand -1."""
    s, first, last = _c(seq), F.greatest(_c(start), F.lit(1)), F.least(F.length(_c(seq)), _c(end))
    part = F.substring(s, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    return F.when(_c(strand) == -1, reverse_complement(part)).otherwise(part)


def valid_dna(seq: Column | str) -> Column:
    """The sequence in upper case without surrounding white space; an error if it holds other letters than A, C, G, T, N."""
    s = F.upper(F.btrim(_c(seq)))
    return F.when(s.isNull() | s.rlike("^[ATCGN]*$"), s).otherwise(F.raise_error("sequence holds letters other than A, T, C, G, N"))


def length_warning(seq: Column | str, low: int = 50, high: int = 200) -> Column:
    """A warning for a query sequence whose length, without surrounding white space, is outside the recommended range; else null."""
    n = F.length(F.btrim(_c(seq)))
    text = F.concat(F.lit("Sequence length ("), n.cast("string"), F.lit(f"bp) is outside recommended range ({low}-{high}bp)"))
    return F.when(~n.between(low, high), text)


def contig_of(protein_id: Column | str, when_numeric: bool = False) -> Column:
    """The id without its last ``_part``; with ``when_numeric`` only if that part is all digits. Else the whole id."""
    return F.regexp_replace(_c(protein_id), "_[0-9]+$" if when_numeric else "_[^_]*$", "")


def contig_or_empty(protein_id: Column | str) -> Column:
    """As ``contig_of``, but an empty string for an id without an underscore."""
    return F.regexp_extract(_c(protein_id), "^(.*)_[^_]*$", 1)


def target_key(contig_id: Column | str) -> Column:
    return F.substring_index(_c(contig_id), "_", 1)


def short_orf_id(orf_id: Column | str) -> Column:
    return F.substring_index(_c(orf_id), "_", -1)


def strand_number(symbol: Column | str) -> Column:
    """1 for '+' or null, else -1."""
    return F.when(F.coalesce(_c(symbol), F.lit("+")) == "+", 1).otherwise(-1)


def marker_line(a: Column | str, b: Column | str) -> Column:
    """One mark a column of an aligned pair: '|' match, '.' mismatch, ' ' gap in either row."""
    gap = lambda p, q: (p == "-") | (q == "-")
    marks = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda p, q: F.when(gap(p, q), " ").when(p == q, "|").otherwise("."))
    return F.when(F.length(_c(a)) == 0, "").otherwise(F.array_join(marks, ""))
