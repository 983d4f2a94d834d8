"""Pieces that several training-data operators share: shared-folder tables, skew-safe lookups, text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key is heavy when it holds more than 1/HEAVY of all rows; so there are fewer than HEAVY heavy keys, at any size.
HEAVY = 1000


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


#: Bytes and rows of an Arrow batch: whole texts go through, and a batch of them is what a Python worker holds at a time.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 10_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session has been told how much to send a Python worker at a time.

    The setting is read when tasks are planned, so it stays with the session; a single longer text is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode.

    On a cluster a temporary folder would be another one on each machine, so there the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed to c0, c1, ..., and the new name of each: no name of theirs can clash with an operator's."""
    places = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*places.values()), places


def skew_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, deal: str) -> DataFrame:
    """Left join of rows with table (one row a key, holding in `weight` how many of `rows` have the key).

    Keys with more than 1/HEAVY of `total` rows are fewer than HEAVY, so they are broadcast whatever the input's
    size; every other key is joined by a shuffle where no key holds more than 1/HEAVY of the rows. Rows that the
    broadcast has answered, and rows without a key, are dealt out by the hash of column `deal` in that shuffle; key and
    deal are one struct, so the shuffle cannot fall back on a partitioning by the key alone. Rows may have any column names.
    """
    plain, own = by_place(rows)
    heavy = F.col(weight) * HEAVY > F.lit(total)
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.filter(heavy).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{i}") for i, c in enumerate(values)], F.lit(True).alias("hit"))
    cold = table.filter(~heavy & F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), F.lit(0).alias("salt")).alias("cold_key"), *[F.col(c).alias(f"cold_{i}") for i, c in enumerate(values)])
    first = plain.join(F.broadcast(hot), F.col(own[key]) == F.col("hot_key"), "left")
    salt = F.when(F.col("hit") | F.col(own[key]).isNull(), F.pmod(F.xxhash64(own[deal]), F.lit(1_000_003)).cast("int") + 1).otherwise(F.lit(0))
    both = first.join(cold, F.struct(F.col(own[key]).alias("key"), salt.alias("salt")) == F.col("cold_key"), "left")
    return both.select(*[F.col(own[c]).alias(c) for c in rows.columns], *[F.when(F.col("hit"), F.col(f"hot_{i}")).otherwise(F.col(f"cold_{i}")).alias(c) for i, c in enumerate(values)])
