"""Builders of codon-weight tables: quality control of coding sequences, RSCU and CAI, anticodon counts and tAI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonlake.functions import sequence as S
from codonlake.functions.codons import AMINO_OF, CODONS, STOPS

#: Gene names of ribosomal proteins; isotype and anticodon in a tRNA gene's name.
REFERENCE_GENE = "(?i)^RP[LS][0-9]"
ANTICODON = "(?i)tRNA-[A-Za-z]{3}-([ACGTU]{3})"
#: Selective constraints of dos Reis et al. (2004): wobble of the third base with the next-best tRNA.
WOBBLE = {"T": ("C", 0.41), "C": ("T", 0.28), "A": ("T", 0.9999), "G": ("A", 0.68)}
FEW_REFERENCE_GENES = 10


def codon_dimension(spark: SparkSession) -> DataFrame:
    """(ord, codon, aa) of all 64 codons in TCAG order."""
    return spark.createDataFrame([(i, c, AMINO_OF[c]) for i, c in enumerate(CODONS)], "ord int, codon string, aa string")


def sound(seq: Column, codons: Column) -> Column:
    """A coding sequence: ATG, whole codons of ACGT, one stop, at the end."""
    inner = F.slice(codons, 1, F.greatest(F.size(codons) - 1, F.lit(0)))
    return F.rlike(seq, F.lit("^ATG([ACGT]{3})+$")) & F.element_at(codons, -1).isin(*STOPS) & ~F.exists(inner, lambda c: c.isin(*STOPS))


def checked(records: DataFrame) -> DataFrame:
    """records (rec_id, header, seq) with seq normalised, gene, valid, reference, and codons (null unless valid).

    Sequence and codons are bound, so that a row's are derived once and not wherever they are named.
    """
    def of(seq: Column) -> Column:
        whole = S.bound(S.codons(seq), lambda c: F.when(sound(seq, c), c))
        return F.struct(seq.alias("seq"), F.when(F.length(seq) >= 6, whole).alias("codons"))

    rows = records.withColumn("parts", S.bound(S.normalised(F.col("seq")), of)).withColumn("gene", S.gene_tag(F.col("header")))
    rows = rows.withColumns({"seq": F.col("parts.seq"), "codons": F.col("parts.codons"), "valid": F.col("parts.codons").isNotNull()}).drop("parts")
    return rows.withColumn("reference", F.col("valid") & F.coalesce(F.rlike("gene", F.lit(REFERENCE_GENE)), F.lit(False)))


def counters(rows: DataFrame) -> DataFrame:
    """total, valid and reference records."""
    return rows.agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_valid"), F.count_if("reference").alias("n_ref"))


def families(spark: SparkSession) -> DataFrame:
    """(aa, n_codons, codons): synonymous codons, stops removed."""
    return codon_dimension(spark).filter("aa <> '*'").groupBy("aa").agg(F.count("*").alias("n_codons"), F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons"))


def _without_last(codons: Column) -> Column:
    return F.slice(codons, 1, F.greatest(F.size(codons) - 1, F.lit(0)))


def codon_totals(rows: DataFrame) -> DataFrame:
    """(codon, count) over the reference genes of `checked` rows, each without its last codon."""
    counted = F.when(F.col("reference"), _without_last(F.col("codons")))
    return rows.select(F.explode(counted).alias("codon")).groupBy("codon").agg(F.count("*").alias("count"))


def rscu(totals: DataFrame) -> DataFrame:
    """(codon, aa, count, rscu, cai_weight) of the 61 sense codons; not rounded."""
    dim = codon_dimension(totals.sparkSession).filter("aa <> '*'")
    rows = F.broadcast(dim).join(totals, "codon", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    family = Window.partitionBy("aa")
    mean = F.sum("count").over(family) / F.count("*").over(family)
    rows = rows.withColumn("rscu", F.coalesce(S.safe_ratio(F.col("count"), mean), F.lit(0.0)))
    return rows.select("codon", "aa", "count", "rscu", F.coalesce(S.safe_ratio(F.col("rscu"), F.max("rscu").over(family)), F.lit(0.0)).alias("cai_weight"))


GENES = "genes"


def cai_weights(records: DataFrame, warn=print) -> DataFrame:
    """(codon, amino_acid, count, rscu, cai_weight), rounded to four places, of the reference genes of records.

    One pass counts codons and genes (each gene adds one mark to its codons); of it one row a codon reaches the driver.
    """
    marked = F.when(F.col("reference"), F.concat(_without_last(F.col("codons")), F.array(F.lit(GENES))))
    totals = checked(records).select(F.explode(marked).alias("codon")).groupBy("codon").agg(F.count("*").alias("count"))
    found = {r["codon"]: r["count"] for r in totals.collect()}
    if found.pop(GENES, 0) < FEW_REFERENCE_GENES:
        warn(f"fewer than {FEW_REFERENCE_GENES} reference genes: weights will be unreliable")
    counts = records.sparkSession.createDataFrame(sorted(found.items()), "codon string, count long")
    return rscu(counts).select("codon", F.col("aa").alias("amino_acid"), "count", F.round("rscu", 4).alias("rscu"), F.round("cai_weight", 4).alias("cai_weight"))


def anticodons_of(lines: DataFrame) -> DataFrame:
    """(anticodon, gene_copy_number) over all matches in lines(line)."""
    found = lines.filter(F.startswith("line", F.lit(">"))).select(F.explode(F.regexp_extract_all("line", F.lit(ANTICODON), F.lit(1))).alias("a"))
    return found.groupBy(S.normalised(F.col("a")).alias("anticodon")).agg(F.count("*").alias("gene_copy_number"))


def cleaned_anticodons(counts: DataFrame) -> DataFrame:
    """Counts with normalised anticodons; malformed ones are dropped, repeated ones summed."""
    name = S.normalised(F.trim("anticodon"))
    rows = counts.select(name.alias("anticodon"), "gene_copy_number").filter(F.rlike("anticodon", F.lit("^[ACGT]{3}$")))
    return rows.groupBy("anticodon").agg(F.sum("gene_copy_number").cast("long").alias("gene_copy_number"))


def tai_weights(counts: DataFrame) -> DataFrame:
    """(codon, amino_acid, tai_weight) of the 60 codons; wobble is added before stops and ATG are left out."""
    dim = codon_dimension(counts.sparkSession)
    own = F.broadcast(dim).withColumn("anticodon", S.reverse_complement(F.col("codon"))).join(counts, "anticodon", "left")
    own = own.withColumn("t", F.coalesce(F.col("gene_copy_number").cast("double"), F.lit(0.0))).withColumn("third", F.substring("codon", 3, 1))
    box = Window.partitionBy(F.substring("codon", 1, 2))
    other = {b: F.max(F.when(F.col("third") == b, F.col("t"))).over(box) for b in "TCA"}
    w = None
    for base, (partner, s) in WOBBLE.items():
        value = F.col("t") + F.lit(1 - s) * other[partner]
        w = F.when(F.col("third") == base, value) if w is None else w.when(F.col("third") == base, value)
    kept = own.withColumn("w", w).filter((F.col("aa") != "*") & (F.col("codon") != "ATG"))
    whole = Window.partitionBy()
    kept = kept.withColumn("top", F.max("w").over(whole))
    kept = kept.withColumn("rel", S.safe_ratio(F.col("w"), F.col("top")))
    kept = kept.withColumn("mean", F.exp(F.avg(F.when(F.col("rel") > 0, F.ln("rel"))).over(whole)))
    value = F.when(F.col("rel") > 0, F.col("rel")).otherwise(F.col("mean"))
    return kept.select("codon", F.col("aa").alias("amino_acid"), F.round(F.when(F.col("top") > 0, value).otherwise(F.raise_error(F.lit("all adaptiveness values are zero")).cast("double")), 4).alias("tai_weight"))


def merged(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Per-species tables side by side. CAI: every species must have every codon; tAI: missing ones count as 0."""
    value = f"{kind}_weight"
    species = list(tables)
    out = None
    for s in species:
        one = tables[s].select("codon", F.col(value).alias(f"{value}_{s}"))
        out = one if out is None else out.join(one, "codon", "full")
    dim = codon_dimension(out.sparkSession).select("codon", F.col("aa").alias("amino_acid"))
    names = [f"{value}_{s}" for s in species]
    if kind == "cai":
        values = [F.coalesce(n, F.raise_error(F.concat(F.lit("no weight for codon "), F.col("codon"))).cast("double")).alias(n) for n in names]
    else:
        values = [F.coalesce(n, F.lit(0.0)).alias(n) for n in names]
    return out.join(F.broadcast(dim), "codon").select("codon", "amino_acid", *values)
