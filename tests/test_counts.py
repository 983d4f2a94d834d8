"""Counts in one pass against Python's own str.count."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonlake.functions import counts, sequence as S
from codonlake.functions.codons import SENSE


def sequences(seed):
    rng = random.Random(seed)
    out = [None, "", "A", "AC", "ACG", "A" * 50, "AC" * 30, "ACA" * 20, "AACAA" * 12, "ACACA" * 9, "AACAACAAAACAACAA", "ACNGT", "acgt", "Aé" * 9 + "AAAA", "\n" + "AAA" * 3]
    return out + ["".join(rng.choices("ACGTN", [9, 3, 1, 1, 0.2], k=rng.randrange(120))) for _ in range(200)]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_counts_are_those_of_python(k):
    rows = sequences(k)
    got, sizes = counts.word_counts(pa.array(rows), k, S.LISTED)
    for i, s in enumerate(rows):
        assert sizes[i] == len(s or "")
        assert got[i].tolist() == [(s or "").count(w) for w in S.kmers(k)], s


def test_slices_chunks_and_empty_batches():
    rows = pa.array(sequences(9))
    whole, _ = counts.word_counts(rows, 3, S.LISTED)
    part, _ = counts.word_counts(rows.slice(20, 70), 3, S.LISTED)
    assert (part == whole[20:90]).all() and counts.word_counts(rows.slice(0, 0), 2, S.LISTED)[0].shape == (0, 16)
    assert counts.word_counts(pa.array([None, None], pa.string()), 2, S.LISTED)[0].sum() == 0
    with pytest.raises(ValueError, match="a table has"):
        counts.word_counts(rows, 7, S.LISTED)


def test_frequencies_and_codons_as_columns(spark):
    rows = sequences(3)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string").repartition(3)
    out = df.select("i", *[S.kmer_frequencies(F.col("s"), k).alias(f"k{k}") for k in (2, 4)], S.codon_counts(F.col("s"), SENSE).alias("c")).collect()
    for r in out:
        s = rows[r["i"]]
        for k in (2, 4):
            want = None if s is None or len(s) < k else [s.count(w) / (len(s) - k + 1) for w in S.kmers(k)]
            assert r[f"k{k}"] == want
        frame = [s[i : i + 3] for i in range(0, len(s) - 2, 3)] if s is not None else []
        assert r["c"] == (None if s is None else [frame.count(c) for c in SENSE])
    assert np.array(out[0]["c"] is None or out[0]["c"]).size
