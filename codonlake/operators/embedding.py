"""Sequence embeddings: preparation, providers, pooling, and a cache of vectors by content.

Foundation models are not part of this package; a provider is any function from a list of sequences to a list of token
matrices. The one here hashes k-mers to fixed pseudo-random directions: deterministic, and fit for testing pipelines.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from codonlake.functions import sequence as S
from codonlake.sources.store import content, held, shared_root, stored
from codonlake.sources.vectors import VectorCache

RNAFM_LONGEST = 1022
NT_TOKENS = 1000
POOLINGS = ("mean", "max", "cls")


def rnafm_input(seq: Column, longest: int = RNAFM_LONGEST) -> Column:
    return F.left(S.rna(seq), F.lit(longest))


def nt_input(seq: Column) -> Column:
    return S.normalised(seq)


def rnafm_key(seq: Column, pooling: str = "mean", longest: int = RNAFM_LONGEST) -> Column:
    """Key by pooling, length limit and the raw sequence."""
    return S.content_key(seq, pooling, str(longest))


def nt_key(seq: Column, model: str, pooling: str = "mean", tokens: int = NT_TOKENS) -> Column:
    return S.content_key(seq, model, pooling, str(tokens))


def hashed_kmers(width: int, k: int = 6) -> Callable[[list[str]], list[np.ndarray]]:
    """A provider: one token for each k bases, a direction drawn from the token's hash."""

    def run(sequences: list[str]) -> list[np.ndarray]:
        out = []
        for s in sequences:
            tokens = [s[i : i + k] for i in range(0, len(s), k)] or [""]
            seeds = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in tokens]
            out.append(np.stack([np.random.default_rng(x).standard_normal(width).astype(np.float32) for x in seeds]))
        return out

    return run


def pooled(tokens: np.ndarray, pooling: str) -> np.ndarray:
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling!r}; known: {', '.join(POOLINGS)}")
    return {"mean": lambda: tokens.mean(0), "max": lambda: tokens.max(0), "cls": lambda: tokens[0]}[pooling]()


def embedded(rows: DataFrame, provider: Callable[[], Callable], pooling: str = "mean", batch: int = 8) -> DataFrame:
    """(seq_hash, embedding) of rows(seq_hash, seq); the model is made once a task, sequences go longest first in batches."""
    pooled(np.zeros((1, 1)), pooling)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            model = model or provider()
            part = part.sort_values("seq", key=lambda s: -s.str.len(), kind="stable")
            vectors = []
            for i in range(0, len(part), batch):
                vectors += [pooled(t, pooling).astype(np.float32).tolist() for t in model(part["seq"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"seq_hash": part["seq_hash"], "embedding": vectors})

    return rows.select("seq_hash", "seq").mapInPandas(run, "seq_hash string, embedding array<float>")


def missing(rows: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct sequences that the cache does not hold."""
    once = rows.dropDuplicates(["seq_hash"])
    return once if cache is None else once.join(cache.select("seq_hash"), "seq_hash", "left_anti")


def cached_through(rows: DataFrame, path: str, provider: Callable[[], Callable], pooling: str = "mean") -> DataFrame:
    """rows with their embedding; new vectors go to the cache at `path`, which the cluster shares and other jobs may fill too."""
    cache = VectorCache(rows.sparkSession, path)
    new = cache.missing(rows.select("seq_hash", "seq"))
    batch = content(new, "seq_hash")
    if not batch.startswith("0-"):
        cache.append(embedded(new, provider, pooling), batch)
    return cache.found(rows)


def unstacked(rows: DataFrame, prefix: str, width: int, vector: str = "embedding") -> DataFrame:
    """The vector as columns prefix_0 ...; other columns stay."""
    rest = [c for c in rows.columns if c != vector]
    return rows.select(*rest, *[F.col(vector)[i].alias(f"{prefix}_{i}") for i in range(width)])


def pooled_vectors(rows: DataFrame, keys: list[str], pooling: str, vector: str = "embedding") -> DataFrame:
    """Mean or largest value by position over the vectors of a group: (keys, pos, value)."""
    long = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    how = {"mean": F.avg, "max": F.max}
    if pooling not in how:
        raise ValueError(f"unknown pooling {pooling!r}; known: {', '.join(how)}")
    return long.groupBy(*keys, "pos").agg(how[pooling](F.col("x").cast("double")).alias("value"))


#: Rows that one length range of batches() is meant to hold, and the most ranges.
RANGE_ROWS = 100_000
MOST_RANGES = 4096


def batches(rows: DataFrame, size: int = 8, key: str = "gene_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with batch: numbers of equal-size batches, longest sequences first, equal lengths by key.

    Rows are sorted by Spark's range sort over (length, key), which splits equal lengths too; a row's rank is its place in its
    partition plus the rows of the partitions before, of which there is one count each.
    """
    ranges = min(MOST_RANGES, max(1, -(-rows.count() // range_rows)))
    sized = rows.withColumn("_len", F.coalesce(F.length("seq"), F.lit(0)))
    placed = held(sized.repartitionByRange(ranges, F.desc("_len"), F.col(key)).withColumn("_part", F.spark_partition_id()))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # at most MOST_RANGES rows
    ahead = before.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_len"), key))
    out = placed.withColumn("_own", own).join(F.broadcast(ahead), F.col("_part") == F.col("_p"))
    return out.withColumn("batch", F.floor((F.col("_own") + F.col("_ahead") - 1) / size)).drop("_len", "_part", "_own", "_p", "_ahead", "_n")


def combined(features: DataFrame, vectors: DataFrame, key: str = "gene_id") -> DataFrame:
    """Hand-made and embedding columns of the same rows, joined by key and stored; a missing row on either side is an error.

    Both sides and the join are counted while the join is written, in one job; if they differ, nothing is stored.
    """
    spark = features.sparkSession
    seen = [Observation() for _ in range(3)]
    count = F.count(F.lit(1)).alias("n")
    joined = features.observe(seen[0], count).join(vectors.observe(seen[1], count), key).observe(seen[2], count)

    def check() -> None:
        n, m, both = (o.get["n"] for o in seen)
        if not n == m == both:
            raise ValueError(f"feature blocks do not cover the same rows: {n} and {m}, {both} in common")

    return stored(spark, f"{shared_root(spark)}/combined/{uuid.uuid4().hex}", lambda: joined, check)


def matrix_key(path: str, species: str, most: int | None, source: str, width: int, pooling: str = "mean") -> str:
    """Name of a stored matrix of embeddings: input, species, number of rows, model and its parameters."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    limits = {"rnafm": f"rnafm_{pooling}_L{RNAFM_LONGEST}", "nt": f"nt_hashed_{pooling}_T{NT_TOKENS}"}
    return f"{stem}_{species}_{'full' if most is None else f'n{most}'}_{limits[source]}_{width}"


def feature_sets(which: str, source: str) -> list[str]:
    """Labels of the runs that --features asks for: the embedding alone, with all hand-made features, or both."""
    joint = {"rnafm": "rnafm_combined", "nt": "nt_plus_full"}[source]
    sets = {source: [source], "combined": [joint], "both": [source, joint]}
    if which not in sets:
        raise ValueError(f"unknown feature set {which!r}; known: {', '.join(sets)}")
    return sets[which]
