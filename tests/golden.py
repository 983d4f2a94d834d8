"""Published tables, as text: codon counts of human ribosomal protein genes with their RSCU, and human tRNA gene counts."""

#: Codon, count, RSCU.
RSCU_TEXT = """
AAA 4905 0.8305
AAC 2151 0.9949
AAG 6907 1.1695
AAT 2173 1.0051
ACA 2003 1.0962
ACC 2037 1.1148
ACG 823 0.4504
ACT 2446 1.3386
AGA 2276 1.295
AGC 2396 1.3422
AGG 1870 1.064
AGT 2481 1.3898
ATA 1143 0.5003
ATC 3041 1.331
ATG 3210 1.0
ATT 2670 1.1687
CAA 1541 0.5583
CAC 2346 1.1252
CAG 3979 1.4417
CAT 1824 0.8748
CCA 2381 1.224
CCC 2309 1.187
CCG 750 0.3856
CCT 2341 1.2034
CGA 1156 0.6578
CGC 2014 1.1459
CGG 2114 1.2028
CGT 1115 0.6344
CTA 1017 0.4147
CTC 2436 0.9932
CTG 5641 2.2999
CTT 2435 0.9928
GAA 5185 0.9655
GAC 3420 0.8782
GAG 5556 1.0345
GAT 4369 1.1218
GCA 2434 0.9983
GCC 3311 1.3579
GCG 743 0.3047
GCT 3265 1.3391
GGA 2790 1.0863
GGC 3213 1.251
GGG 2050 0.7982
GGT 2220 0.8644
GTA 1198 0.5185
GTC 1870 0.8093
GTG 3884 1.681
GTT 2290 0.9911
TAC 1820 0.9592
TAT 1975 1.0408
TCA 1666 0.9332
TCC 1814 1.0162
TCG 279 0.1563
TCT 2075 1.1624
TGC 996 0.9235
TGG 1506 1.0
TGT 1161 1.0765
TTA 1425 0.581
TTC 2747 0.9446
TTG 1762 0.7184
TTT 3069 1.0554
"""
#: Anticodon, gene copies.
ANTICODON_TEXT = """
AAC 10
AAG 9
AAT 15
ACG 7
AGA 9
AGC 26
AGG 9
AGT 9
ATA 1
CAA 7
CAC 13
CAG 9
CAT 11
CCA 7
CCC 5
CCG 4
CCT 5
CGA 4
CGC 4
CGG 4
CGT 5
CTC 8
CTG 13
CTT 15
GAA 10
GAT 3
GCA 29
GCC 14
GCT 8
GTA 13
GTC 13
GTG 9
GTT 25
TAA 4
TAC 5
TAG 3
TAT 5
TCA 1
TCC 9
TCG 6
TCT 6
TGA 4
TGC 8
TGG 7
TGT 6
TTC 8
TTG 6
TTT 12
"""
