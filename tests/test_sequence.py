import pytest
from pyspark.sql import functions as F

from codonlake.functions import features, sequence as S
from codonlake.functions.codons import SENSE


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).first()["x"]


def test_counts_do_not_overlap(spark):
    assert one(spark, S.count_of(F.col("s"), "AA"), s="AAAA") == 2
    assert one(spark, S.count_of(F.col("s"), "ATA"), s="ATATA") == 1
    assert one(spark, S.count_of(F.col("s"), "ATG"), s="") == 0


def test_kmer_frequencies(spark):
    di = dict(zip(S.kmers(2), one(spark, S.kmer_frequencies(F.col("s"), 2), s="AAAA"), strict=True))
    assert di["AA"] == pytest.approx(2 / 3) and sum(di.values()) == pytest.approx(2 / 3)
    assert one(spark, S.kmer_frequencies(F.col("s"), 3), s="AC") is None
    assert one(spark, S.gc_fraction(F.col("s")), s="") is None
    assert one(spark, S.gc_fraction(F.col("s")), s="GCNN") == 0.5


def test_kozak(spark):
    k = S.kozak_score(F.col("u"), F.col("c"))
    assert one(spark, k, u="GCCACC", c="ATGG") == 1.0
    assert one(spark, k, u="GCCTCC", c="AAAA") == pytest.approx(5 / 7)
    assert one(spark, k, u="GCCAC", c="ATGG") is None


def test_codons_and_windows(spark):
    assert one(spark, S.codons(F.col("s")), s="ATGAAAC") == ["ATG", "AAA"]
    assert one(spark, S.codons(F.col("s")), s="") == []
    counts = one(spark, S.codon_counts(F.col("s"), SENSE), s="ATGAAAAAATAANNN")
    assert dict(zip(SENSE, counts, strict=True))["AAA"] == 2 and sum(counts) == 3
    assert one(spark, S.start_window(F.col("u"), F.col("c")), u="A" * 40, c="C" * 5) == "A" * 30 + "C" * 5
    with pytest.raises(ValueError):
        S.start_window(F.col("u"), F.col("c"), 0)


def test_regions_clamp_and_reject_negative(spark):
    rows = spark.createDataFrame([(1, "acgu", None, 2), (2, "ACGT", 9, 9)], "gene_id long, tx_sequence string, utr5_size int, cds_size int")
    got = {r["gene_id"]: (r["utr5"], r["cds"], r["utr3"]) for r in features.with_regions(rows).collect()}
    assert got == {1: ("", "AC", "GT"), 2: ("ACGT", "", "")}
    with pytest.raises(Exception, match="negative"):
        features.with_regions(rows.withColumn("utr5_size", F.lit(-1))).collect()


def test_adaptation_uses_its_own_codons(spark):
    rows = spark.createDataFrame([(1, "ATGTGC", 0, 6), (2, "TAA", 0, 3), (3, "ATG", 0, 3)], "gene_id long, tx_sequence string, utr5_size int, cds_size int")
    got = {r["gene_id"]: r for r in features.matrix(rows, groups=["cai", "tai"]).collect()}
    assert got[1]["cai"] == pytest.approx(0.8579**0.5) and got[1]["tai"] == pytest.approx(1.0)
    assert got[2]["cai"] is None and got[3]["cai"] == 1.0 and got[3]["tai"] is None


def test_dictionary():
    assert len(features.FEATURES) == 326 and len(set(features.FEATURES)) == 326
    regions = [features.classify(n)[1] for n in features.FEATURES]
    assert {r: regions.count(r) for r in set(regions)} == {"cds": 149, "utr5": 87, "utr3": 86, "full": 2, "window": 2}
    with pytest.raises(ValueError):
        features.chosen(["nothing"])
