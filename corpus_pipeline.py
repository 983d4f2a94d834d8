"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Defined results of every stage: other columns stay as they are, whatever their names; an empty table gives an empty one.
Null and empty texts, and texts without letters, have no language and go in the first stage; so do all texts if no label
teaches a language. Of equal texts the row with the largest id stays, null being the smallest; rows that repeat id and
text become one. Texts without words are near duplicates of nothing. A null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import decontaminate, exact_dedup, language, minmax_dedup, mixing
from codonlake.llm.common import by_place, written

MIXED = ("size", "source_size", "target", "taken")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; lang is the prediction."""
    return language.identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return minmax_dedup.dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes any words, with size, source_size, target and taken (words taken, repeats counted).

    A column of docs that bears one of those four names is left out. Rows that repeat both id and text get the same
    numbers, those of the row of which most is taken.
    """
    taken = mixing.mix(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("mixed_id"), F.col("text_hash").alias("mixed_text"))
    mixed = taken.agg(F.max(F.struct("taken", "size", "source_size", "target")).alias("m")).select("mixed_id", "mixed_text", *[F.col(f"m.{c}").alias(c) for c in MIXED])
    plain, place = by_place(docs)
    same = F.col(place["doc_id"]).cast("long").eqNullSafe(F.col("mixed_id")) & (F.xxhash64(place["text"]) == F.col("mixed_text"))
    return plain.join(mixed, same).select(*[F.col(p).alias(c) for c, p in place.items() if c not in MIXED], *MIXED)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
