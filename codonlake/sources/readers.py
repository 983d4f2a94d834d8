"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codonlake.functions.codons import Tables
from codonlake.sources import fasta as fasta_source
from codonlake.sources import files, workbook

COLUMNS = {"gene_id": "long", "tx_sequence": "string", "utr5_size": "int", "cds_size": "int", "fold": "int", "te": "double"}
#: The same as a schema; streams are read by it.
TRANSCRIPTS = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
CAI_TABLES = "codon string, amino_acid string, cai_weight_human double, cai_weight_mouse double"
TAI_TABLES = "codon string, amino_acid string, tai_weight_human double, tai_weight_mouse double"
CAI_SPECIES = "codon string, amino_acid string, cai_weight double"
TAI_SPECIES = "codon string, amino_acid string, tai_weight double"
ANTICODONS = "anticodon string, gene_copy_number int"


def target_of(columns: list[str], target: str | None = None) -> str:
    """The target's column: the one named, or `te`, or the only one that begins with TE_."""
    if target is not None and target in columns:
        return target
    if "te" in columns:
        return "te"
    found = [c for c in columns if c.startswith("TE_")]
    if target is not None or len(found) != 1:
        raise ValueError(f"which column is the target? wanted {target or 'te'}, found {', '.join(found) or 'none'}")
    return found[0]


def transcripts(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Parquet, CSV with a header, or a workbook (its first sheet) of transcripts, by column names.

    Without gene_id rows are numbered; what is no number becomes null, and so does NaN.
    """
    if path.endswith(".xlsx"):
        found = workbook.register(spark).read.format("workbook").load(path).schema
        value = target_of(found.names, target)
        wanted = [f for f in found.fields if f.name in COLUMNS or f.name == value]
        rows = spark.read.format("workbook").schema(StructType(wanted)).load(path)
    else:
        rows = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    if "gene_id" not in rows.columns:
        rows = rows.withColumn("gene_id", F.monotonically_increasing_id())
    value = target_of(rows.columns, target)
    number = lambda c, t: F.col(c).cast("string").try_cast("double").try_cast(t) if t != "string" else F.col(c)
    out = rows.select(*[(F.col(c).try_cast("long") if c == "gene_id" else number(value if c == "te" else c, t)).alias(c) for c, t in COLUMNS.items()])
    return out.withColumn("te", F.when(~F.isnan("te"), F.col("te")))


def weight_tables(spark: SparkSession, cai_path: str, tai_path: str, species: str) -> Tables:
    """A species' weights from combined tables as `build-cai` and `build-tai` write them: a row a codon."""
    found = []
    for kind, path, schema in (("cai", cai_path, CAI_TABLES), ("tai", tai_path, TAI_TABLES)):
        rows = table(spark, path, schema).select("codon", F.col(f"{kind}_weight_{species}").alias("w")).filter("w > 0")
        found.append({r["codon"]: r["w"] for r in rows.collect()})  # a row a codon
    return Tables(species, *found)


def table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def fasta(spark: SparkSession, path: str, split: int = fasta_source.SPLIT) -> DataFrame:
    """(header, seq) of a FASTA file or a folder of them, read in ranges of `split` bytes. Stores that only Spark's own
    readers reach go through `large_fasta`.
    """
    if not files.known(path):
        return large_fasta(spark, path)
    return fasta_source.register(spark).read.format("fasta").schema("header string, seq string").option("split", split).load(path)


def large_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's text reader, split at record marks, for stores that only Spark reaches; files must begin with a record."""
    pieces = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("piece"))
    body = F.regexp_replace(F.regexp_replace("piece", "^[^\n]*", ""), "\\s", "")
    return pieces.select(F.trim(F.substring_index("piece", "\n", 1)).alias("header"), body.alias("seq"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
