"""The feature groups: named columns over the regions of a transcript, and the dictionary of all 326 columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import sequence as S
from codonlake.functions.codons import SENSE, Tables, weights
from codonlake.operators.folding import mfe

KMER_GROUPS = {1: "mono", 2: "di", 3: "kmer3"}
#: Raised when a column's values change, so that stored matrices of older code are not met.
VERSION = 2


@dataclass(frozen=True)
class Block:
    """Names of a group's columns, the region they describe, and their values: an array column, or one column."""

    names: list[str]
    region: str
    value: Callable[[str | Tables], Column]  # of the species, or of given weight tables
    array: bool = False


def _kmer_block(k: int) -> list[Block]:
    return [Block([f"{r}_{m}" for m in S.kmers(k)], r, lambda _, r=r: S.kmer_frequencies(F.col(r), k), True) for r in S.REGIONS]


def _log(name: str) -> Callable[[str], Column]:
    return lambda _: F.log1p(F.length(name).cast("double"))


def _share(_: str) -> Column:
    total = F.aggregate("codon_counts", F.lit(0), lambda a, x: a + x)
    return F.when(total > 0, F.transform("codon_counts", lambda x: x.cast("double") / total))


def _adaptation(kind: str) -> Callable[[str], Column]:
    """Geometric mean of the weights of all codons that have one, from the counts; null if there is none."""

    def value(species: str | Tables) -> Column:
        table = weights(kind, species)
        has = F.array(*[F.lit(1.0 if c in table else 0.0) for c in SENSE])
        logs = F.array(*[F.lit(math.log(table[c]) if c in table else 0.0) for c in SENSE])
        add = lambda a, x: a + x
        n = F.aggregate(F.zip_with("codon_counts", has, lambda c, h: c * h), F.lit(0.0), add)
        total = F.aggregate(F.zip_with("codon_counts", logs, lambda c, w: c * w), F.lit(0.0), add)
        return F.when(n > 0, F.exp(total / n))

    return value


def _named(r: str) -> str:
    """The region of the columns that describe the whole transcript."""
    return "full" if r == "tx" else r


#: Names of groups, columns and regions.
GROUPS: dict[str, list[Block]] = {
    "length": [Block([f"log_{r}"], _named(r), _log(r)) for r in (*S.REGIONS, "tx")],
    "gc": [Block([f"gc_{_named(r)}"], _named(r), lambda _, r=r: S.gc_fraction(F.col(r))) for r in (*S.REGIONS, "tx")],
    "mono": _kmer_block(1),
    "di": _kmer_block(2),
    "kmer3": _kmer_block(3),
    "codon": [Block([f"codon_{c}" for c in SENSE], "cds", _share, True)],
    "uaug": [Block(["uAUG_count"], "utr5", lambda _: S.count_of(F.col("utr5"), "ATG").cast("double"))],
    "kozak": [Block(["kozak_score"], "window", lambda _: S.kozak_score(F.col("utr5"), F.col("cds")))],
    "cai": [Block(["cai"], "cds", _adaptation("cai"))],
    "tai": [Block(["tai"], "cds", _adaptation("tai"))],
    "mfe": [Block(["mfe_start"], "window", lambda _: mfe(S.start_window(F.col("utr5"), F.col("cds"))))],
}
FEATURES = [name for blocks in GROUPS.values() for b in blocks for name in b.names]
#: Group and region of each column, as the groups above list them.
PLACE = {name: (g, b.region) for g, blocks in GROUPS.items() for b in blocks for name in b.names}


def classify(name: str) -> tuple[str, str]:
    """(group, region) of a feature column: from the groups, or for a foreign k-mer column from its name."""
    if name in PLACE:
        return PLACE[name]
    region, _, kmer = name.partition("_")
    return (KMER_GROUPS.get(len(kmer), "unknown"), region) if region in S.REGIONS and kmer else ("unknown", "unknown")


def classified(name: Column) -> tuple[Column, Column]:
    """The same as columns."""
    known = F.try_element_at(F.create_map(*[x for n, (g, r) in PLACE.items() for x in (F.lit(n), F.struct(F.lit(g).alias("g"), F.lit(r).alias("r")))]), name)
    region = F.regexp_extract(name, f"^({'|'.join(S.REGIONS)})_.", 1)
    size = F.length(name) - F.length(region) - 1
    group = F.lit("unknown")
    for k, g in KMER_GROUPS.items():
        group = F.when(size == k, g).otherwise(group)
    foreign = region != ""
    return F.coalesce(known["g"], F.when(foreign, group), F.lit("unknown")), F.coalesce(known["r"], F.when(foreign, region), F.lit("unknown"))


def dictionary(spark: SparkSession) -> DataFrame:
    """(idx, name, grp, region) of all features in order."""
    return spark.createDataFrame([(i, n, *classify(n)) for i, n in enumerate(FEATURES)], "idx int, name string, grp string, region string")


def with_regions(transcripts: DataFrame) -> DataFrame:
    """transcripts with utr5, cds, utr3 and tx (the three together), normalised; rows without a sequence are dropped."""
    rows = transcripts.filter("tx_sequence IS NOT NULL").withColumn("_s", S.normalised(F.col("tx_sequence")))
    rows = rows.withColumns(S.regions(F.col("_s"), F.col("utr5_size"), F.col("cds_size"))).drop("_s")
    return rows.withColumn("tx", F.concat(*S.REGIONS))


def chosen(groups: list[str] | None) -> list[str]:
    unknown = [g for g in groups or () if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}; known: {', '.join(GROUPS)}")
    return [g for g in GROUPS if groups is None or g in groups]


def blocks(transcripts: DataFrame, species: str | Tables = "human", groups: list[str] | None = None, keep: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """One column for each block of the groups, arrays as they are: few columns, so the stage keeps generated code."""
    rows = with_regions(transcripts)
    names = chosen(groups)
    if {"codon", "cai", "tai"} & set(names):
        rows = rows.withColumn("codon_counts", S.codon_counts(F.col("cds"), SENSE))
    return rows.select(*keep, *[b.value(species).alias(f"{g}_{i}") for g in names for i, b in enumerate(GROUPS[g])])


def matrix(transcripts: DataFrame, species: str | Tables = "human", groups: list[str] | None = None, keep: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """One row a gene, one double column a feature, in the order of FEATURES."""
    wide = []
    for g in chosen(groups):
        for i, b in enumerate(GROUPS[g]):
            col = F.col(f"{g}_{i}")
            wide += [(col[j] if b.array else col).alias(n) for j, n in enumerate(b.names)]
    return blocks(transcripts, species, groups, keep).select(*keep, *wide)
