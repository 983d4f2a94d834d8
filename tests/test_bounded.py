"""Steps whose memory or passes must not grow with a batch or a table."""

import numpy as np
import pyarrow as pa
import pytest

from codonlake.functions import counts
from codonlake.operators import folding, validation
from codonlake.plans import fixtures, pipeline
from codonlake.sources import store


def test_words_are_counted_by_slices_of_a_batch(monkeypatch):
    rng = np.random.default_rng(1)
    column = pa.array([None if i % 9 == 0 else "".join(rng.choice(list("ACGTN"), rng.integers(0, 40))) for i in range(200)])
    whole = [counts.frequencies(column, 3, "ATGC"), counts.codons_in_frame(column, ["ATG", "TTT"], "ATGC")]
    seen, plain = [], counts.encoded
    monkeypatch.setattr(counts, "encoded", lambda part, letters: seen.append(sum(len(x or "") for x in part.to_pylist())) or plain(part, letters))
    monkeypatch.setattr(counts, "SLICE", 100)
    assert [counts.frequencies(column, 3, "ATGC"), counts.codons_in_frame(column, ["ATG", "TTT"], "ATGC")] == whole
    assert max(seen) <= 100 + 40 and len(counts.frequencies(column.slice(0, 0), 3, "ATGC")) == 0


def test_a_matrix_with_a_source_is_named_without_reading_the_rows(spark, sf, monkeypatch):
    def read(*_):
        raise AssertionError("the rows were read for their digest")

    monkeypatch.setattr(store, "content", read)
    rows, names = pipeline.prepared(fixtures.transcripts(spark, sf), "C1", source=fixtures.source(spark, sf))
    assert rows.count() > 0 and names == ["uAUG_count", "kozak_score"]


def test_optimality_is_summed_in_products_for_all_folds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, (90, 3))
    y = x[:, 0] - x[:, 2] + rng.standard_normal(90)
    rows = spark.createDataFrame([(i, i % 3, float(y[i]), *map(float, x[i])) for i in range(90)], "gene_id long, fold int, te double, a double, b double, c double")
    monkeypatch.setattr(type(rows), "mapInPandas", None)  # no frame of standardised rows
    got = {(r["fold"], r["feature"]): r["violation"] for r in validation.violations(rows, list("abc"), "Lasso").collect()}
    fitted = validation.Sums.of(rows, list("abc")).fit(list("abc"), "Lasso")[0]
    for f, m in fitted.items():
        own = np.arange(90) % 3 != f
        z = (x[own] - m.means) / m.deviations
        slope = z.T @ (y[own] - m.intercept - z @ m.coefficients) / own.sum()
        for j, n in enumerate("abc"):
            w = m.coefficients[j]
            assert got[f, n] == pytest.approx(max(abs(slope[j]) - 0.001, 0) if w == 0 else abs(slope[j] - 0.001 * np.sign(w)), abs=1e-9)


def test_windows_are_folded_with_few_calls(monkeypatch):
    calls, plain = [], np.minimum

    class Counted:
        def __call__(self, *a, **b):
            calls.append(1)
            return plain(*a, **b)

    monkeypatch.setattr(folding.np, "minimum", Counted())
    folding.fold(np.random.default_rng(0).integers(0, 4, (4, 60)).astype(np.int8))
    assert len(calls) < 60_000  # with a call for each place of a branch: 72,264
