"""Support vector regression over distributed rows and trees on cells, against the solvers of one task and plain definitions."""

import numpy as np
import pytest

from codonlake.operators import learners, support, validation

NAMES = list("abcd")


def planted(n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-1, 1, (n, 4)), 1)
    return x, 2 * x[:, 1] + np.sin(3 * x[:, 2]) + 0.1 * rng.standard_normal(n)


def table(spark, x, y):
    return spark.createDataFrame([(i, i % 2, float(y[i]), *map(float, x[i])) for i in range(len(y))], "gene_id long, fold int, te double, a double, b double, c double, d double")


def local(*_):
    raise AssertionError("rows were sent to one task")


def test_linear_machines_are_solved_without_sending_the_rows(spark, monkeypatch):
    x, y = planted()
    monkeypatch.setattr(validation, "_fanned", local)
    got = {r["id"]: r["y_hat"] for r in validation.out_of_fold(table(spark, x, y), NAMES, ["LinearSVM"]).collect()}
    own = np.arange(len(y)) % 2
    for f in (0, 1):
        model = learners.LinearSVR(tolerance=1e-6, most=3000).fit(x[own != f], y[own != f])
        want = model.predict(x[own == f])
        assert np.abs(np.array([got[i] for i in np.flatnonzero(own == f)]) - want).max() < 2e-3


@pytest.mark.parametrize("share", [40, 10**6])
def test_kernel_machines_are_solved_without_sending_the_rows(spark, monkeypatch, share):
    x, y = planted()
    monkeypatch.setattr(validation, "_fanned", local)
    monkeypatch.setattr(validation, "LOCAL_ROWS", 10)
    monkeypatch.setattr(support, "CURVATURE_ROWS", share)
    rows = table(spark, x, y)
    got = {r["id"]: r["y_hat"] for r in validation.out_of_fold(rows, NAMES, ["SVR"]).collect()}
    own = np.arange(len(y)) % 2
    for f in (0, 1):
        want = learners.KernelSVR(tolerance=1e-6).fit(x[own != f], y[own != f]).predict(x[own == f])
        assert np.abs(np.array([got[i] for i in np.flatnonzero(own == f)]) - want).max() < 2e-3
    value = [r["importance"] for r in validation.importances(rows, NAMES, ["SVR"]).collect()]
    want = learners.permutation_importance(learners.KernelSVR().fit(x, y), x, y)
    assert np.abs(np.array(value) - want).max() < 0.1 * want.max() and int(np.argmax(value)) == 1


def test_landmarks_leave_no_row_outside_their_span(spark):
    x, y = planted()
    means, deviations = x.mean(0), x.std(0)
    marks = support.landmarks(table(spark, x, y), NAMES, means, deviations, 0.25, len(y))
    z, m = (x - means) / deviations, (marks - means) / deviations
    v = support.radial(z, m, 0.25) @ support._inverse_root(support.radial(m, m, 0.25))
    assert (1 - (v * v).sum(1)).max() <= 2 * support.RESIDUAL and len(np.unique(marks, axis=0)) == len(marks)


def test_too_many_landmarks_fall_back_to_all_rows_in_a_task(spark, monkeypatch):
    x, y = planted(60)
    monkeypatch.setattr(validation, "LOCAL_ROWS", 10)
    monkeypatch.setattr(support, "MOST_LANDMARKS", 5)
    got = {r["id"]: r["y_hat"] for r in validation.out_of_fold(table(spark, x, y), NAMES, ["SVR"]).collect()}
    own = np.arange(60) % 2
    assert [got[i] for i in np.flatnonzero(own == 0)] == pytest.approx(learners.KernelSVR().fit(x[own == 1], y[own == 1]).predict(x[own == 0]).tolist())


@pytest.mark.parametrize("name", ["LightGBM", "XGBoost", "RandomForest"])
def test_trees_work_on_cells_of_equal_rows(monkeypatch, name):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (500, 4)).astype(float)
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.standard_normal(500)
    sizes = []
    for grown in ("grow", "grow_levels"):
        plain = getattr(learners, grown)
        monkeypatch.setattr(learners, grown, lambda codes, *a, plain=plain, **b: sizes.append(len(codes)) or plain(codes, *a, **b))
    model = learners.make(name, 0.02).fit(x, y)
    assert max(sizes) <= 81
    monkeypatch.setattr(learners, "cells", lambda codes: (np.arange(len(codes)), np.arange(len(codes))))
    alone = learners.make(name, 0.02).fit(x, y)
    assert max(sizes) == 500 and np.allclose(model.predict(x), alone.predict(x)) and np.allclose(model.importance, alone.importance)


def test_kernel_machines_gather_the_rows_near_the_edge_only_and_close_the_gap(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(-1, 1, (6000, 2)), 1)
    y = np.sin(3 * x[:, 0]) + x[:, 1] + rng.uniform(-1, 1, 6000)
    rows = spark.createDataFrame([(i, 0, float(y[i]), *map(float, x[i])) for i in range(6000)], "gene_id long, fold int, te double, a double, b double").cache()
    monkeypatch.setattr(support, "FIRST_ROWS", 500)
    monkeypatch.setattr(support, "GUARDS", 300)
    monkeypatch.setattr(support, "MOST_PASSES", 0)  # none of the barrier's passes
    taken, plain = [], support._freed
    monkeypatch.setattr(support, "_freed", lambda spaces, asked: taken.append(asked) or plain(spaces, asked))
    space = support.spaces_of(rows, list("ab"), [None], True)[0]
    w = support.solved(rows, list("ab"), [space], "SVR")[0]
    whole = [asked for asked in taken if asked[0][4] == support.C]
    for asked in whole:
        free = support._split(np.column_stack([y, x]), space, asked[0][1], asked[0][2])[0].sum()
        assert 0 < free < 3000
    assert 1 <= len(whole) <= 6
    kernel = support.radial(space.marks, space.marks, space.gamma)
    primal = w[:-1] @ kernel @ w[:-1] / 2 + np.maximum(np.abs(y - space.predict(x, w)) - 0.1, 0).sum()
    root = support._inverse_root(kernel)
    own = support.Space(None, space.means, space.deviations, space.gamma, space.marks, root)
    at_once, gap, _ = support.interior(own, np.column_stack([y, x, np.ones(6000), np.zeros(6000)]), np.zeros(space.width + 1), 1.0, 0.0, 1e-7)
    least = at_once[:-1] @ at_once[:-1] / 2 + np.maximum(np.abs(y - own.predict(x, at_once)) - 0.1, 0).sum()
    assert primal <= least * (1 + support.GAP) and gap <= 1e-6 * least


def test_equal_rows_share_their_kernel_values(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (3000, 2)).astype(float)
    space = support.Space(None, np.zeros(2), np.ones(2), 0.5, np.unique(x, axis=0))
    w = rng.standard_normal(17)
    want = support.radial(x, space.marks, 0.5) @ w[:-1] + w[-1]
    sizes, plain = [], support.radial
    monkeypatch.setattr(support, "radial", lambda a, b, gamma: sizes.append(len(a)) or plain(a, b, gamma))
    assert np.allclose(space.predict(x, w), want, atol=1e-12) and sum(sizes) == 16
    free, side, left, _, basis, place = support._split(np.column_stack([np.zeros(3000), x]), space, [w], 0.1)
    assert np.allclose(left, -want) and len(basis) == 16 and np.array_equal(free, np.abs(np.abs(left) - 0.1) <= 0.1) and sum(sizes) == 32
    few, place = support.distinct(x)
    assert len(few) == 16 and np.array_equal(few[place], x)
    assert len(support.distinct(rng.standard_normal((3000, 2)))[0]) == 3000
    monkeypatch.setattr(support, "KEPT_BYTES", 0)
    space.root = support._inverse_root(plain(space.marks, space.marks, 0.5))
    rows = np.column_stack([want, x, np.ones(3000), np.zeros(3000)])
    sizes.clear()
    again = support.interior(space, rows, np.zeros(17), 1.0, 0.0, 1e-6)
    assert max(sizes) == 16 and again[1] < 1e-3
