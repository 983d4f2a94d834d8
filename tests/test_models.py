"""Learners against plain definitions: exhaustive splits, optimality conditions, duality gaps, refits by hand."""

import numpy as np
import pandas as pd
import pytest

from codonlake.operators import learners, linear, validation


def data(n=90, p=4, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-1, 1, (n, p)), 1)
    return x, 2 * x[:, 1] + np.sin(3 * x[:, 2]) + 0.1 * rng.standard_normal(n)


def best_gain(x, g, least, ridge):
    """The largest gain of any split of these rows, over all columns and cuts."""
    def score(part):
        return part.sum() ** 2 / (len(part) + ridge)

    best = 0.0
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                best = max(best, score(g[left]) + score(g[~left]) - score(g))
    return best


def walk(tree, node, x, y, check):
    if tree.feature[node] < 0:
        return check(node, x, y, None)
    left = x[:, tree.feature[node]] <= tree.cut[node]
    check(node, x, y, left)
    walk(tree, tree.left[node], x[left], y[left], check)
    walk(tree, tree.right[node], x[~left], y[~left], check)


@pytest.mark.parametrize(("least", "ridge"), [(1, 1.0), (20, 0.0), (3, 0.5)])
def test_every_split_of_a_boosted_tree_is_the_best(least, ridge):
    x, y = data()
    codes, cuts = learners.binned(x)
    tree, parts = learners.grow(codes, cuts, y, np.arange(len(y)), np.arange(4), np.zeros(4), leaves=64, depth=6, least=least, ridge=ridge)

    def check(node, own, g, left):
        if left is None:
            assert tree.value[node] == pytest.approx(g.sum() / (len(g) + ridge))
            return
        score = lambda part: part.sum() ** 2 / (len(part) + ridge)
        assert score(g[left]) + score(g[~left]) - score(g) == pytest.approx(best_gain(own, g, least, ridge)) and min(left.sum(), (~left).sum()) >= least

    walk(tree, 0, x, y, check)
    assert sorted(np.concatenate([p for _, p in parts]).tolist()) == list(range(len(y)))


def test_leaf_wise_trees_open_the_best_leaf_first():
    x, y = data()
    codes, cuts = learners.binned(x)
    tree, _ = learners.grow(codes, cuts, y, np.arange(len(y)), np.arange(4), np.zeros(4), leaves=5, depth=64, least=5, ridge=0.0)
    assert sum(f < 0 for f in tree.feature) == 5
    gains = []
    walk(tree, 0, x, y, lambda node, own, g, left: gains.append((left is not None, best_gain(own, g, 5, 0.0))))
    assert min(g for opened, g in gains if opened) >= max(g for opened, g in gains if not opened) - 1e-9


def test_every_split_of_a_forest_tree_with_all_features_is_the_best():
    x, y = data()
    codes, cuts = learners.binned(x)
    tree = learners.grow_levels(codes, cuts, y, np.arange(len(y)), np.zeros(4), k=4, depth=1 << 20, rng=np.random.default_rng(0))

    def check(node, own, g, left):
        assert tree.value[node] == pytest.approx(g.mean())
        if left is None:
            assert best_gain(own, g - g.mean(), 1, 0.0) < 1e-9
        else:
            spread = lambda part: ((part - part.mean()) ** 2).sum()
            assert spread(g) - spread(g[left]) - spread(g[~left]) == pytest.approx(best_gain(own, g - g.mean(), 1, 0.0))

    walk(tree, 0, x, y, check)


def test_boosting_adds_shrunken_trees_of_the_residuals():
    x, y = data()
    model = learners.Boosted(4, rate=0.1, leaves=8, depth=3, least=2, ridge=1.0, columns=1.0).fit(x, y)
    f = np.full(len(y), y.mean())
    for tree in model.trees:
        left = y - f
        walk(tree, 0, x, left, lambda node, own, g, split: None if split is not None else pytest.approx(g.sum() / (len(g) + 1.0)) == tree.value[node] or pytest.fail("leaf"))  # noqa: B023
        f = f + 0.1 * tree.predict(x)
    assert np.allclose(model.predict(x), f)


def test_kernel_svr_closes_its_duality_gap():
    x, y = data(70)
    model = learners.KernelSVR(tolerance=1e-6).fit(x, y)
    z = (x - model.mean) / model.dev
    kernel = model._kernel(model.x, model.x)
    norm = model.beta @ kernel @ model.beta
    loss = np.maximum(np.abs(model.predict(x) - y) - model.epsilon, 0).sum()
    at = {tuple(r): v for r, v in zip(model.x, y[[int(np.flatnonzero((z == r).all(1))[0]) for r in model.x]], strict=True)}
    dual = sum(at[tuple(r)] * b for r, b in zip(model.x, model.beta, strict=True)) - model.epsilon * np.abs(model.beta).sum() - norm / 2
    assert np.abs(model.beta).max() <= model.c + 1e-9 and abs(model.beta.sum()) < 1e-9
    assert norm / 2 + model.c * loss - dual == pytest.approx(0, abs=2e-3)


def test_linear_svr_closes_its_duality_gap():
    x, y = data(70)
    model = learners.LinearSVR(tolerance=1e-8).fit(x, y)
    w = np.append(model.coefficients, model.bias)
    primal = w @ w / 2 + np.maximum(np.abs(model.predict(x) - y) - model.epsilon, 0).sum()
    rng = np.random.default_rng(0)
    nearby = []
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(200):
            v = w + size * rng.standard_normal(len(w))
            p = (x - model.mean) / model.dev @ v[:-1] + v[-1]
            nearby.append(v @ v / 2 + np.maximum(np.abs(p - y) - model.epsilon, 0).sum())
    assert primal <= min(nearby) + 1e-6


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_out_of_fold_equals_refits_by_hand(spark, offset):
    x, y = data(60)
    rows = spark.createDataFrame([(i, i % 3, float(y[i]) + offset, *(float(v) + offset for v in x[i])) for i in range(60)], "gene_id long, fold int, te double, a double, b double, c double, d double")
    names, fold = list("abcd"), np.arange(60) % 3
    got = {(r["model"], r["id"]): r["y_hat"] - offset for r in validation.out_of_fold(rows, names, ["Lasso", "ElasticNet", "RandomForest"], 0.02).collect()}
    for f in range(3):
        train, test = fold != f, np.flatnonzero(fold == f)
        mean, dev = x[train].mean(0), x[train].std(0)
        z = (x[train] - mean) / dev
        for m, (alpha, share) in linear.PENALTIES.items():
            w, target = np.zeros(4), y[train] - y[train].mean()
            for _ in range(3000):  # plain proximal gradient descent
                step = w - 0.3 * (z.T @ (z @ w - target) / train.sum() + alpha * (1 - share) * w)
                w = np.sign(step) * np.maximum(np.abs(step) - 0.3 * alpha * share, 0)
            for i in test:
                assert got[m, i] == pytest.approx((x[i] - mean) / dev @ w + y[train].mean(), abs=2e-3)
        if offset == 0.0:
            forest = learners.make("RandomForest", 0.02).fit(x[train], y[train])
            assert [got["RandomForest", i] for i in test] == pytest.approx(forest.predict(x[test]).tolist())


def test_importances_by_hand(spark):
    x, y = data(60)
    rows = spark.createDataFrame([(i, i % 3, float(y[i]), *map(float, x[i])) for i in range(60)], "gene_id long, fold int, te double, a double, b double, c double, d double")
    got = validation.importances(rows, list("abcd"), ["SVR", "LightGBM", "RandomForest", "LinearSVM", "Lasso"], 0.05).collect()
    assert list(dict.fromkeys(r["model"] for r in got)) == ["Lasso", "LinearSVM", "RandomForest", "LightGBM", "SVR"]
    by = {m: [r["importance"] for r in got if r["model"] == m] for m in {r["model"] for r in got}}
    assert sum(by["RandomForest"]) == pytest.approx(1) and by["LightGBM"] == pytest.approx(learners.make("LightGBM", 0.05).fit(x, y).importance.tolist())
    svr = learners.make("SVR").fit(x, y)
    assert by["SVR"] == pytest.approx(learners.permutation_importance(svr, x, y).tolist()) and int(np.argmax(by["SVR"])) == 1
    assert all((r["signed_coef"] is None) == (r["model"] not in ("Lasso", "LinearSVM")) for r in got)
    assert all(abs(r["signed_coef"]) == r["importance"] for r in got if r["signed_coef"] is not None)


@pytest.mark.parametrize(("name", "bound"), [("LightGBM", 4.0), ("XGBoost", 4.5)])
def test_boosting_counts_the_smaller_child_only(monkeypatch, name, bound):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 4))
    y = x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]) + rng.standard_normal(6000)
    counted, plain = [0], np.bincount
    monkeypatch.setattr(learners, "DIRECT", 1 << 40)
    want = learners.make(name, 0.01).fit(x, y)
    monkeypatch.setattr(learners, "DIRECT", 50)
    monkeypatch.setattr(learners.np, "bincount", lambda a, *b, **c: counted.__setitem__(0, counted[0] + len(a)) or plain(a, *b, **c))
    got = learners.make(name, 0.01).fit(x, y)
    assert counted[0] <= bound * 2 * 4 * 6000 * len(got.trees)  # rows of all nodes that were counted, by round
    assert [t.feature for t in got.trees] == [t.feature for t in want.trees] and [t.code for t in got.trees] == [t.code for t in want.trees]
    assert np.allclose(got.predict(x), want.predict(x), atol=1e-12) and np.array_equal(got.trees[0].predict(x), got.trees[0].dealt(list(learners.coded(x, got.cuts).T)))


def test_each_key_has_a_task_and_rows_pass_the_driver_by(spark, monkeypatch):
    from pyspark import TaskContext
    from pyspark.sql import DataFrame

    rows = spark.range(0, 500, 1, 4).selectExpr("499 - id AS gene_id", "CAST(id % 10 AS INT) AS fold", "CAST(id AS DOUBLE) AS te", "id / 7.0E0 AS a")
    keys = [("LightGBM", f) for f in range(10)]

    def work(key, data):
        assert data["gene_id"].tolist() == list(range(500)) and data["te"].tolist() == [499.0 - i for i in range(500)]
        return pd.DataFrame({"model": [key[0]], "fold": [key[1]], "task": [TaskContext.get().partitionId()]})

    for most in (1 << 40, 0):
        monkeypatch.setattr(validation, "BROADCAST_BYTES", most)
        if not most:
            monkeypatch.setattr(DataFrame, "toPandas", None)
        got = validation._fanned(rows, ["a"], keys, work, "model string, fold int, task int").collect()
        assert sorted((r["model"], r["fold"]) for r in got) == keys and len({r["task"] for r in got}) == 10


def test_a_forest_predicts_as_it_grows_and_keeps_no_tree(spark, monkeypatch):
    x, y = data(200)
    model = learners.Forest(20)
    got = model.foretold(x[:150], y[:150], x[150:])
    kept = learners.Forest(20).fit(x[:150], y[:150])
    assert np.array_equal(got, kept.predict(x[150:])) and np.array_equal(model.importance, kept.importance) and not hasattr(model, "trees")
    rows = spark.createDataFrame([(i, i % 2, float(y[i]), *map(float, x[i])) for i in range(200)], "gene_id long, fold int, te double, a double, b double, c double, d double")

    def fit(*_):
        raise AssertionError("all trees are held at once")

    monkeypatch.setattr(learners.Forest, "fit", fit)
    assert validation.out_of_fold(rows, list("abcd"), ["RandomForest"], 0.02).count() == 200
    assert validation.importances(rows, list("abcd"), ["RandomForest"], 0.02).count() == 4


def test_a_tree_of_any_size_takes_arrays_only():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 4))
    y = rng.standard_normal(2000)
    tree = learners.Forest(1).fit(x, y).trees[0]
    parts = (tree.feature, tree.cut, tree.left, tree.right, tree.value)
    assert len(tree.value) > 1000 and all(isinstance(v, np.ndarray) and v.dtype.itemsize <= 8 for v in parts)
