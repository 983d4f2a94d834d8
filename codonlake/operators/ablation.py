"""Ablations: which feature columns a run sees, and the model-ready selection of rows and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.functions.features import FEATURES, GROUPS, classify

VALID_REGIONS = ("utr5", "cds", "utr3", "full", "window")


@dataclass(frozen=True)
class Spec:
    groups: tuple[str, ...]
    regions: tuple[str, ...] | None = None


#: Id, feature groups and, after a bar, regions of each ablation.
ABLATION_TEXT = """
A1 gc
A2 gc mono
A3 gc mono di
A4 gc mono di kmer3
A5 gc mono di kmer3 length
A6 gc mono di kmer3 length codon
A7 gc mono di kmer3 length codon uaug
A8 gc mono di kmer3 length codon uaug kozak
A9 gc mono di kmer3 length codon uaug kozak cai
A10 gc mono di kmer3 length codon uaug kozak tai
A11 gc mono di kmer3 length codon uaug kozak cai tai
A12 gc mono di kmer3 length codon uaug kozak cai tai mfe
A13 gc mono di kmer3 length codon uaug kozak cai tai mfe
A1_cai gc cai
A1_tai gc tai
A1_cai_tai gc cai tai
A2_cai gc mono cai
A2_tai gc mono tai
A2_cai_tai gc mono cai tai
A3_cai gc mono di cai
A3_tai gc mono di tai
A3_cai_tai gc mono di cai tai
A4_cai gc mono di kmer3 cai
A4_tai gc mono di kmer3 tai
A4_cai_tai gc mono di kmer3 cai tai
A5_cai gc mono di kmer3 length cai
A5_tai gc mono di kmer3 length tai
A5_cai_tai gc mono di kmer3 length cai tai
A6_cai gc mono di kmer3 length codon cai
A6_tai gc mono di kmer3 length codon tai
A6_cai_tai gc mono di kmer3 length codon cai tai
B1 length gc mono di kmer3 | utr5
B2 length gc mono di kmer3 | cds
B3 length gc mono di kmer3 | utr3
B4 length gc mono di kmer3 | utr5 cds
B5 length gc mono di kmer3 | cds utr3
C1 uaug kozak
C2 codon cai tai
C3 uaug kozak codon cai tai
D1 kmer3
D2 codon
D3 kmer3 codon
D4 kozak mfe
"""


def _read(text: str) -> dict[str, Spec]:
    out = {}
    for line in text.strip().splitlines():
        left, _, right = line.partition("|")
        name, *groups = left.split()
        out[name] = Spec(tuple(groups), tuple(right.split()) or None)
    return out


def checked(specs: dict[str, Spec]) -> dict[str, Spec]:
    for name, spec in specs.items():
        if bad := [g for g in spec.groups if g not in GROUPS]:
            raise ValueError(f"ablation {name}: unknown groups {bad}")
        if bad := [r for r in spec.regions or () if r not in VALID_REGIONS]:
            raise ValueError(f"ablation {name}: unknown regions {bad}")
    return specs


ABLATIONS = checked(_read(ABLATION_TEXT))


def as_spec(spec: str | Spec | list | tuple | dict | None) -> Spec:
    """A catalogue id, a list of groups, a dict with groups and regions, or None for everything."""
    if isinstance(spec, Spec):
        return spec
    if spec is None:
        return Spec(tuple(GROUPS))
    if isinstance(spec, str):
        return ABLATIONS[spec]
    if isinstance(spec, dict):
        regions = spec.get("regions")
        out = Spec(tuple(spec["groups"]), tuple(regions) if regions else None)
    else:
        out = Spec(tuple(spec))
    return checked({"given": out})["given"]


def columns(spec, names: list[str] | None = None) -> list[str]:
    """The feature columns that a spec selects, in their order; none is an error."""
    s = as_spec(spec)
    out = [n for n in (FEATURES if names is None else names) for g, r in (classify(n),) if g in s.groups and (s.regions is None or r in s.regions)]
    if not out:
        raise ValueError(f"no feature column is left for groups {list(s.groups)} and regions {list(s.regions or ())}")
    return out


def usable(rows: DataFrame, target: str = "te", most: int | None = None, key: str = "gene_id") -> DataFrame:
    """Rows with a target and a sequence; of these the first `most` by key."""
    out = rows.dropna(subset=[target, "tx_sequence"])
    return out if most is None else out.orderBy(key).limit(most)


def imputed(rows: DataFrame, names: list[str], value: float = 0.0) -> DataFrame:
    """Nulls and NaNs of the named columns as a constant; other columns stay as they are."""
    done = {n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(value)), F.lit(value)) for n in names}
    return rows.select(*[done[c].alias(c) if c in done else F.col(c) for c in rows.columns])


def prepared(matrix: DataFrame, spec, keep: tuple[str, ...] = ("gene_id", "fold", "te")) -> tuple[DataFrame, list[str]]:
    """The spec's columns of a feature matrix, imputed, with the columns to keep; and the features' names."""
    names = columns(spec, [c for c in matrix.columns if c not in keep])
    return imputed(matrix.select(*keep, *names), names), names
