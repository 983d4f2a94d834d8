"""Genetic code and codon weights."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

BASES = "TCAG"
#: Amino acids of the standard code (NCBI table 1), codons in TCAG order, third base fastest; * is a stop.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODONS = [a + b + c for a in BASES for b in BASES for c in BASES]
AMINO_OF = dict(zip(CODONS, AMINO, strict=True))
STOPS = [c for c in CODONS if AMINO_OF[c] == "*"]
#: The 61 sense codons in ACGT order, as feature columns list them.
SENSE = sorted(c for c in CODONS if AMINO_OF[c] != "*")

#: Codon, CAI weight human, mouse.
CAI_TEXT = """
AAA 0.7101 0.5796
AAC 0.9899 1.0
AAG 1.0 1.0
AAT 1.0 0.6745
ACA 0.8189 0.9064
ACC 0.8328 1.0
ACG 0.3365 0.3666
ACT 1.0 0.8284
AGA 1.0 1.0
AGC 0.9657 1.0
AGG 0.8216 0.931
AGT 1.0 0.7651
ATA 0.3759 0.233
ATC 1.0 1.0
ATG 1.0 1.0
ATT 0.878 0.7565
CAA 0.3873 0.3251
CAC 1.0 1.0
CAG 1.0 1.0
CAT 0.7775 0.7062
CCA 1.0 0.994
CCC 0.9698 0.8187
CCG 0.315 0.2627
CCT 0.9832 1.0
CGA 0.5079 0.6299
CGC 0.8849 0.7419
CGG 0.9288 0.9026
CGT 0.4899 0.4943
CTA 0.1803 0.1985
CTC 0.4318 0.4704
CTG 1.0 1.0
CTT 0.4317 0.4442
GAA 0.9332 0.7721
GAC 0.7828 0.8814
GAG 1.0 1.0
GAT 1.0 1.0
GCA 0.7351 0.6861
GCC 1.0 1.0
GCG 0.2244 0.2316
GCT 0.9861 0.9757
GGA 0.8683 0.7802
GGC 1.0 1.0
GGG 0.638 0.5708
GGT 0.6909 0.6277
GTA 0.3084 0.3126
GTC 0.4815 0.544
GTG 1.0 1.0
GTT 0.5896 0.5926
TAC 0.9215 1.0
TAT 1.0 0.8112
TCA 0.6715 0.5626
TCC 0.7312 0.8144
TCG 0.1125 0.1897
TCT 0.8364 0.8483
TGC 0.8579 0.9899
TGG 1.0 1.0
TGT 1.0 1.0
TTA 0.2526 0.2062
TTC 0.8951 1.0
TTG 0.3124 0.3434
TTT 1.0 0.9739
"""

#: Codon, tAI weight human, mouse (no ATG).
TAI_TEXT = """
AAA 0.4138 0.2222
AAC 0.8621 0.2407
AAG 0.6497 0.423
AAT 0.5086 0.142
ACA 0.2069 0.0741
ACC 0.2234 0.12
ACG 0.2386 0.0978
ACT 0.3103 0.1667
AGA 0.2069 0.0926
AGC 0.2759 0.1296
AGG 0.2386 0.1222
AGT 0.1628 0.0765
ATA 0.1725 0.0926
ATC 0.4759 0.1467
ATT 0.5783 0.2037
CAA 0.2069 0.1111
CAC 0.3103 0.1852
CAG 0.5145 0.2207
CAT 0.1831 0.1093
CCA 0.2414 0.1296
CCC 0.2234 0.08
CCG 0.2152 0.097
CCT 0.3103 0.1111
CGA 0.2069 0.0926
CGC 0.1738 0.08
CGG 0.2041 0.0852
CGT 0.2414 0.1111
CTA 0.1035 0.0556
CTC 0.2234 0.0667
CTG 0.3434 0.203
CTT 0.3103 0.0926
GAA 0.2759 0.1481
GAC 0.4483 0.2963
GAG 0.3641 0.2511
GAT 0.2645 0.1748
GCA 0.276 0.2037
GCC 0.6455 0.1733
GCG 0.2262 0.2504
GCT 0.8966 0.2407
GGA 0.3103 0.1296
GGC 0.4828 0.2541
GGG 0.2717 0.1526
GGT 0.2848 0.1606
GTA 0.1724 0.0556
GTC 0.2483 0.1067
GTG 0.5034 0.203
GTT 0.3448 0.1481
TAC 0.4731 0.1852
TAT 0.299 0.1093
TCA 0.138 0.0556
TCC 0.2234 0.1252
TCG 0.1821 0.0733
TCT 0.3103 0.1591
TGC 1.0 1.0
TGG 0.2524 0.16
TGT 0.59 0.59
TTA 0.1379 0.0741
TTC 0.3448 0.1296
TTG 0.2855 0.0978
TTT 0.2034 0.0765
"""

SPECIES = ("human", "mouse")


def _table(text: str) -> dict[str, dict[str, float]]:
    rows = [line.split() for line in text.strip().splitlines()]
    return {s: {r[0]: float(r[1 + i]) for r in rows} for i, s in enumerate(SPECIES)}


CAI = _table(CAI_TEXT)
TAI = _table(TAI_TEXT)


@dataclass(frozen=True)
class Tables:
    """Weight tables of a user's own, in the place of a species' built-in ones."""

    name: str
    cai: dict[str, float]
    tai: dict[str, float]


def weights(kind: str, species: str | Tables) -> dict[str, float]:
    """Codon weights of a species; all positive, as their logarithms are averaged."""
    if isinstance(species, Tables):
        found = {"cai": species.cai, "tai": species.tai}[kind]
    else:
        table = {"cai": CAI, "tai": TAI}[kind]
        if species not in table:
            raise ValueError(f"unknown species {species!r}; known: {', '.join(SPECIES)}")
        found = table[species]
    if unknown := sorted(set(found) - set(SENSE)):
        raise ValueError(f"{kind} weights name unknown codons: {', '.join(unknown)}")
    if any(w <= 0 for w in found.values()):
        raise ValueError(f"{kind} weights must be positive")
    return found


def weights_key(species: str | Tables) -> str:
    """Name of the species or tables, and a digest of the weights."""
    values = [sorted(weights(kind, species).items()) for kind in ("cai", "tai")]
    return f"{species if isinstance(species, str) else species.name}-{hashlib.sha1(repr(values).encode()).hexdigest()[:12]}"
