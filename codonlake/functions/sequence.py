"""Column expressions over sequence strings. All but two are built-in functions and stay in the JVM; k-mers and codons are
counted by Arrow UDFs, a batch of sequences in one pass. All of them stream.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codonlake.functions import counts

REGIONS = ("utr5", "cds", "utr3")
#: Order in which base, dimer and trimer columns are listed.
LISTED = "ATGC"


def normalised(seq: Column) -> Column:
    """Upper case, U as T."""
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row: the optimiser would else repeat it wherever it is named, and inside a
    lambda once for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, null where bottom is 0 or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def size_of(col: Column) -> Column:
    """A region size: null counts as 0, negative sizes raise."""
    return F.when(col < 0, F.raise_error(F.lit("region sizes must not be negative")).cast("int")).otherwise(F.coalesce(col, F.lit(0)).cast("int"))


def regions(seq: Column, utr5_size: Column, cds_size: Column) -> dict[str, Column]:
    """utr5, cds and utr3 of a normalised sequence; sizes beyond its end are clamped."""
    five, coding = size_of(utr5_size), size_of(cds_size)
    return {
        "utr5": F.substring(seq, F.lit(1), five),
        "cds": F.substring(seq, five + 1, coding),
        "utr3": F.substring(seq, five + coding + 1, F.greatest(F.length(seq), F.lit(1))),
    }


def start_window(utr5: Column, cds: Column, upstream: int = 30, downstream: int = 30) -> Column:
    """The last bases of the 5' UTR and the first ones of the CDS."""
    if upstream <= 0 or downstream <= 0:
        raise ValueError("window sizes must be positive")
    return F.concat(F.right(utr5, F.lit(upstream)), F.left(cds, F.lit(downstream)))


def count_of(seq: Column, piece: Column | str) -> Column:
    """Non-overlapping occurrences, from the left."""
    p = F.lit(piece) if isinstance(piece, str) else piece
    return ((F.length(seq) - F.length(F.replace(seq, p, F.lit("")))) / F.length(p)).cast("int")


def kmers(k: int) -> list[str]:
    return ["".join(p) for p in product(LISTED, repeat=k)]


def kmer_frequencies(seq: Column, k: int) -> Column:
    """Array of the frequencies of all k-mers in listed order: non-overlapping counts over n - k + 1; null if n < k."""

    @F.arrow_udf("array<double>")
    def kmers_of(column: pa.Array) -> pa.Array:
        return counts.frequencies(column, k, LISTED)

    return kmers_of(seq)


def gc_fraction(seq: Column) -> Column:
    return bound(seq, lambda s: safe_ratio(F.length(s) - F.length(F.replace(F.replace(s, F.lit("G"), F.lit("")), F.lit("C"), F.lit(""))), F.length(s)))


def codons(cds: Column) -> Column:
    """In-frame codons from the start; a partial last one is dropped."""
    return F.regexp_extract_all(cds, F.lit("(.{3})"), F.lit(1))


def codon_counts(cds: Column, order: list[str]) -> Column:
    """Counts of the codons of `order` among the in-frame codons, as an array of integers."""

    @F.arrow_udf("array<int>")
    def codons_of(column: pa.Array) -> pa.Array:
        return counts.codons_in_frame(column, order, LISTED)

    return codons_of(cds)


def kozak_score(utr5: Column, cds: Column) -> Column:
    """Share of the seven positions -6..-1 and +4 around the start codon that fit GCC[AG]CC and G."""
    context = F.when((F.length(utr5) >= 6) & (F.length(cds) >= 4), F.concat(F.right(utr5, F.lit(6)), F.left(cds, F.lit(4))))
    places = ((1, "G"), (2, "C"), (3, "C"), (4, "AG"), (5, "C"), (6, "C"), (10, "G"))

    def score(c: Column) -> Column:
        fits = [F.substring(c, p, 1).isin(*b).cast("int") for p, b in places]
        return sum(fits[1:], fits[0]).cast("double") / 7

    return bound(context, score)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def gene_tag(header: Column) -> Column:
    """The name in `[gene=NAME]`, null where there is none."""
    return F.nullif(F.regexp_extract(header, r"\[gene=([^\]]+)\]", 1), F.lit(""))


def content_key(seq: Column, *parts: str) -> Column:
    """Key of a cached vector: digest of the parameters and the raw sequence."""
    return F.sha1(F.concat_ws("|", *[F.lit(p) for p in parts], seq).cast("binary"))
