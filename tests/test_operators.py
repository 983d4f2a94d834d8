import numpy as np
import pytest

from codonlake.functions import metrics
from codonlake.operators import ablation, embedding, folding, learners, linear, validation, weights
from codonlake.operators.ranking import heatmap
from codonlake.plans import fixtures as X


def test_ablation_counts():
    n = {i: len(ablation.columns(i)) for i in ablation.ABLATIONS}
    assert len(n) == 43
    assert [n[f"A{i}"] for i in range(1, 14)] == [4, 16, 64, 256, 260, 321, 322, 323, 324, 324, 325, 326, 326]
    assert [n[f"B{i}"] for i in range(1, 6)] == [86, 86, 86, 172, 172] and [n[f"C{i}"] for i in range(1, 4)] == [2, 63, 65] and [n[f"D{i}"] for i in range(1, 5)] == [192, 61, 253, 2]
    with pytest.raises(ValueError):
        ablation.columns({"groups": ["kozak"], "regions": ["utr3"]})
    with pytest.raises(ValueError):
        ablation.as_spec(["nothing"])


def test_weights_wobble(spark):
    counts = spark.createDataFrame([("GCA", 29), ("CCA", 7), ("TCA", 1)], "anticodon string, gene_copy_number int")
    got = {r["codon"]: r["tai_weight"] for r in weights.tai_weights(counts).collect()}
    assert len(got) == 60 and got["TGC"] == 1.0 and got["TGG"] == pytest.approx(0.2524) and got["TGT"] == pytest.approx(0.59)


def test_coordinate_descent_meets_optimality():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 12))
    y = x[:, 0] * 2 - x[:, 3] + rng.standard_normal(200) * 0.1
    x = (x - x.mean(0)) / x.std(0)
    g, xy = x.T @ x / 200, x.T @ (y - y.mean()) / 200
    for alpha, l1 in ((0.05, 1.0), (0.05, 0.5)):
        w = linear.coordinate_descent(g, xy, alpha, l1, tolerance=1e-10)
        slope = xy - g @ w - alpha * (1 - l1) * w
        assert np.allclose(slope[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope[w == 0]) <= alpha * l1 + 1e-6).all()


def planted(n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 5))
    return x, 2 * x[:, 1] + np.sin(3 * x[:, 2]) + 0.05 * rng.standard_normal(n)


@pytest.mark.parametrize("name", ["RandomForest", "LightGBM", "XGBoost", "SVR", "LinearSVM"])
def test_learners_find_planted_signal(name):
    x, y = planted()
    model = learners.make(name, 0.2).fit(x, y)
    xt, yt = planted(seed=9)
    r2 = 1 - ((yt - model.predict(xt)) ** 2).sum() / ((yt - yt.mean()) ** 2).sum()
    assert r2 > 0.6
    value = getattr(model, "importance", None)
    value = np.abs(model.coefficients) if value is None and hasattr(model, "coefficients") else value
    value = learners.permutation_importance(model, x, y) if value is None else value
    assert int(np.argmax(value)) == 1


def test_few_rows_give_constant_leafwise_trees():
    x, y = planted(20)
    assert len(set(learners.make("LightGBM", 0.01).fit(x, y).predict(x).round(12))) == 1


def test_out_of_fold_covers_each_row_once(spark):
    x, y = planted(60)
    rows = spark.createDataFrame([(i, i % 3, float(y[i]), *map(float, x[i])) for i in range(60)], "gene_id long, fold int, te double, a double, b double, c double, d double, e double")
    names = list("abcde")
    oof = validation.out_of_fold(rows, names, ["Lasso", "ElasticNet", "LinearSVM"])
    got = oof.groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in got} == {"Lasso": 60, "ElasticNet": 60, "LinearSVM": 60}
    assert oof.select("model", "id").distinct().count() == 180
    scores = {r["model"]: r["r2"] for r in metrics.scores(oof, ["model"]).collect()}
    assert min(scores.values()) > 0.6
    imp = validation.importances(rows, names, ["Lasso", "SVR"])
    top = {r["model"]: r["feature"] for r in imp.orderBy("importance").collect()}
    assert top == {"Lasso": "b", "SVR": "b"}
    with pytest.raises(ValueError):
        validation.out_of_fold(rows.selectExpr("gene_id", "CAST(NULL AS INT) AS fold", "te", *names), names, ["Lasso"]).collect()


def test_summary_layout(spark, sf):
    got = {(r["model"], r["fold"]) for r in metrics.summary(X.predictions(spark, sf), ["model"], strict=True).collect()}
    assert {("odd", f) for f in ("0", "1", "2", "3", "mean", "std", "oof")} <= got


def test_heatmap_zero_model_is_null(spark, sf):
    rows = {(r["feature"], r["model"]): r["value"] for r in heatmap(X.importances(spark, sf), 2).collect()}
    assert all(v is None for (_, m), v in rows.items() if m == "SVR") and {m for _, m in rows} == {"SVR", "Lasso", "RandomForest"}
    assert all(max(v for (_, m), v in rows.items() if m == own) == 1.0 for own in ("Lasso", "RandomForest"))


def test_folding():
    import pandas as pd

    e = folding.energies(pd.Series(["GGGGAAAACCCC", "AAAAAAAA", "", None, "GGGGNNNNCCCC"]))
    assert e[0] == pytest.approx(-4.18) and e[1] == 0 and e[2] != e[2] and e[3] != e[3] and e[4] == pytest.approx(-4.18)


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "ACGT"), (3, "GG")], "gene_id long, seq string").selectExpr("*", "sha1(seq) AS seq_hash")
    path = str(tmp_path / "cache")
    for _ in range(2):
        out = embedding.cached_through(rows, path, lambda: embedding.hashed_kmers(4)).collect()
        assert len(out) == 3 and spark.read.parquet(f"{path}/data").count() == 2
    assert embedding.feature_sets("both", "nt") == ["nt", "nt_plus_full"]
    with pytest.raises(ValueError):
        embedding.pooled(np.zeros((1, 1)), "median")


def test_fasta_and_reports(spark, sf, tmp_path):
    from codonlake.plans import pipeline
    from codonlake.sources import readers

    f = tmp_path / "x.fa"
    f.write_text("junk\n>a [gene=RPL1] x>y\nATG\nAAA\n\nTGA\n>b\nCC\n")
    assert [(r["header"], r["seq"]) for r in readers.fasta(spark, str(f)).collect()] == [("a [gene=RPL1] x>y", "ATGAAATGA"), ("b", "CC")]
    out = pipeline.build_cai(spark, {"human": str(f), "mouse": str(f)}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(out).count() == 61
    t = tmp_path / "t.fa"
    t.write_text("\n".join(r["line"] for r in X.trna_lines(spark, sf).collect()))
    out = pipeline.build_tai(spark, {"human": str(t), "mouse": str(t)}, str(tmp_path / "tai"))
    assert spark.read.option("header", True).csv(out).count() == 60


def test_stream_equals_batch(spark, sf, tmp_path):
    from codonlake.streaming import features as stream
    from codonlake.functions import features

    rows = X.transcripts(spark, sf).limit(40)
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.write_features(stream.feature_stream(stream.transcript_stream(spark, str(tmp_path / "in")), groups=["gc"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = features.matrix(spark.read.parquet(str(tmp_path / "in")), groups=["gc"])
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).isEmpty()


@pytest.mark.parametrize("name", ["q_random_forest", "q_gbt_leafwise", "q_gbt_depthwise", "q_importances"])
def test_registered_trees_have_full_size(spark, sf, monkeypatch, name):
    from codonlake.plans import catalog

    seen = []
    for f in ("out_of_fold", "importances"):
        monkeypatch.setattr(validation, f, lambda rows, names, models, scale=1.0: seen.append(scale))
    catalog.QUERIES[name](spark, sf)
    assert seen == [1.0]


def test_forest_grows_until_leaves_are_pure():
    x = np.random.default_rng(2).permutation(60).astype(float)[:, None]
    y = np.sin(x[:, 0])
    codes, cuts = learners.binned(x)
    tree = learners.grow_levels(codes, cuts, y, np.arange(60), np.zeros(1), k=1, depth=1 << 20, rng=np.random.default_rng(0))
    assert np.allclose(tree.predict(x), y) and len(tree.value) == 119


def test_models_do_not_depend_on_the_broadcast_bound(spark, monkeypatch):
    x, y = planted(60)
    rows = spark.createDataFrame([(i, i % 2, float(y[i]), *map(float, x[i])) for i in range(60)], "gene_id long, fold int, te double, a double, b double, c double, d double, e double")
    heavy = ["RandomForest", "LightGBM", "XGBoost", "SVR", "LinearSVM"]

    def results():
        oof = validation.out_of_fold(rows, list("abcde"), heavy, 0.02).collect()
        imp = validation.importances(rows, list("abcde"), heavy, 0.02, 1).collect()
        return {tuple(r)[:3]: r["y_hat"] for r in oof} | {tuple(r)[:2]: r["importance"] for r in imp}

    near = results()
    monkeypatch.setattr(validation, "BROADCAST_BYTES", 0)
    far = results()
    assert len(near) == 5 * 60 + 5 * 5 and far.keys() == near.keys()
    assert all(far[k] == pytest.approx(v, abs=1e-12) for k, v in near.items())


def test_kernel_rows_need_no_whole_kernel(monkeypatch):
    x, y = planted()
    whole = learners.KernelSVR().fit(x, y).predict(x)
    monkeypatch.setattr(learners.KernelSVR, "KERNEL_BYTES", 1)
    assert np.allclose(learners.KernelSVR().fit(x, y).predict(x), whole)


def test_folding_tries_wide_loops():
    import pandas as pd

    helix, back = "GGCGC", "GCGCC"
    hairpin = "GCGGCGAAAACGCCGC"
    loop = lambda left, right: helix + "A" * left + hairpin + "A" * right + back
    e = folding.energies(pd.Series([hairpin, loop(5, 5), loop(9, 9), loop(10, 0), loop(15, 15), loop(16, 16)]))
    outer = sum(folding.STACKS[helix[i : i + 2]] for i in range(4))
    grown = [folding._grown(folding.INTERIOR, n) for n in (10, 18, 30)]
    assert [e[i] for i in (1, 2, 4)] == pytest.approx([round(e[0] + outer + g, 2) for g in grown])
    assert e[3] == pytest.approx(e[0] + outer + folding._grown(folding.BULGE, 10), abs=0.006)
    assert e[5] > e[4] + 0.2  # 32 bases are more than a loop may have


def test_support_vectors_run_until_done_or_warn():
    x, y = planted()
    assert learners.LinearSVR().most == 10_000 and learners.KernelSVR().most is None
    for model in (learners.LinearSVR(most=1), learners.KernelSVR(most=1)):
        with pytest.warns(RuntimeWarning, match="not converged after 1 "):
            model.fit(x, y)


def test_registered_matrix_has_all_columns(spark, sf):
    from codonlake.functions import features
    from codonlake.plans import catalog

    whole, compared = (catalog.QUERIES[q](spark, sf).columns for q in ("q_feature_matrix", "q_feature_matrix_sql"))
    mfe = features.matrix(X.transcripts(spark, sf), groups=["mfe"]).columns
    assert len(whole) == 2 + 326 and set(whole) - set(compared) == set(mfe) - {"gene_id"}
    assert "q_feature_matrix_sql" in catalog.ORACLES
