"""Whole runs: inputs, stores, reports, the command line, and published weight tables."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from codonlake.functions import features, metrics
from codonlake.functions.codons import CAI, SENSE, TAI, Tables, weights_key
from codonlake.operators import embedding, folding, ranking, validation, weights
from codonlake.plans import fixtures as X
from codonlake.plans import pipeline
from codonlake.sources import readers, store
from tests import golden

SCHEMA = "gene_id long, tx_sequence string, utr5_size int, cds_size int, fold int, te double"


def table_of(path):
    return list(csv.DictReader(open(f"{path}.csv")))


def genes(n=36):
    pieces = ("ATGGCC", "GATTACA", "CCGTA", "TTGCA", "GGGAC")
    return [(i, "ACGT" * (i % 3) + "".join(pieces[(i * 7 + j * j) % 5] for j in range(12 + i % 7)), 8 + i % 5, 36, i % 3, (i % 11) / 3.0 + (i % 3)) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rows = spark.createDataFrame(genes(), SCHEMA)
    rows.withColumnRenamed("te", "TE_HCT116").withColumn("TE_other", F.lit(99.0)).write.parquet(f"{root}/human.parquet")
    with open(f"{root}/mouse.csv", "w") as f:
        out = csv.writer(f)
        out.writerow(["fold", "TE_4T1", "tx_sequence", "cds_size", "utr5_size"])
        out.writerows([[r[4], "" if r[0] == 3 else "NaN" if r[0] == 4 else r[5], r[1], r[3], f"{r[2]}.0"] for r in genes()])
    return str(root)


def test_each_dataset_has_its_target(spark, data):
    found = pipeline.datasets(spark, data)
    human, mouse = (readers.transcripts(spark, found[n].path, found[n].target) for n in ("human", "mouse"))
    assert human.columns == mouse.columns == ["gene_id", "tx_sequence", "utr5_size", "cds_size", "fold", "te"]
    assert [tuple(r) for r in human.orderBy("gene_id").collect()] == genes()
    read = sorted((r["tx_sequence"], r["utr5_size"], r["cds_size"], r["fold"], -1.0 if r["te"] is None else r["te"]) for r in mouse.collect())
    assert read == sorted((r[1], r[2], r[3], r[4], -1.0 if r[0] in (3, 4) else pytest.approx(r[5])) for r in genes())
    with pytest.raises(ValueError, match="target"):
        readers.target_of(["TE_a", "TE_b"])
    with pytest.raises(ValueError, match="target"):
        readers.transcripts(spark, f"{data}/human.parquet", "TE_none")
    assert readers.target_of(["x", "TE_a"]) == "TE_a"


def test_stored_features_follow_folds_targets_and_weights(spark):
    rows = spark.createDataFrame(genes(), SCHEMA)
    keep = ("gene_id", "fold", "te")
    first = store.feature_cache(rows, groups=["gc"], keep=keep)
    edited = rows.withColumn("te", F.col("te") + 100).withColumn("fold", F.lit(7))
    again = store.feature_cache(edited, groups=["gc"], keep=keep)
    assert first.agg(F.max("te")).first()[0] < 100 and again.agg(F.min("te"), F.max("fold")).first()[:] == (100.0, 7)
    assert pipeline.prepared(edited, "A1")[0].filter("te < 100").isEmpty()
    flat = Tables("human", dict.fromkeys(SENSE, 0.5), dict.fromkeys(SENSE, 0.5))
    assert weights_key(flat) != weights_key("human")
    own = store.feature_cache(rows, flat, ["cai"]).filter("cai IS NOT NULL")
    assert own.count() and own.filter("abs(cai - 0.5) > 1e-9").isEmpty()
    with pytest.raises(ValueError, match="unknown codons"):
        features.matrix(rows, Tables("x", {"NNN": 1.0}, {}), ["cai"])


def test_run_writes_ordered_reports(spark, data, tmp_path):
    out = str(tmp_path)
    models = ["SVR", "ElasticNet", "Lasso", "RandomForest"]
    pipeline.run_ablations(spark, data, out, ["A1", "C1"], ["human"], models, scale=0.02)
    order = [m for m in ranking.MODEL_ORDER if m in models]
    top = table_of(f"{out}/A1/Human_HCT116_top_features")
    assert list(top[0]) == ["dataset", "model", "feature", "importance", "signed_coef"] and len(top) == 16
    assert list(dict.fromkeys(r["model"] for r in top)) == order
    for m in order:
        values = [float(r["importance"]) for r in top if r["model"] == m]
        assert values == sorted(values, reverse=True)
    assert all((r["signed_coef"] == "") == (r["model"] in ("RandomForest", "SVR")) for r in top)
    full = table_of(f"{out}/C1/Human_HCT116_eval_results")
    assert list(full[0]) == ["dataset", "model", "fold", *metrics.NAMES] and len(full) == 4 * (3 + 3)
    assert {r["fold"] for r in full} == {"0", "1", "2", "mean", "std", "oof"}
    assert len(table_of(f"{out}/C1/Human_HCT116_r2_results")) == 24 and list(table_of(f"{out}/A1/Human_HCT116_heatmap")[0]) == ["feature", *models]
    # the shared pass of cross products gives what a run of its own gives
    rows, names = pipeline.prepared(readers.transcripts(spark, f"{data}/human.parquet", "TE_HCT116"), "C1")
    alone = {r["fold"]: r["r2"] for r in metrics.summary(validation.out_of_fold(rows, names, ["Lasso"]), ["model"], strict=True).collect()}
    shared = {r["fold"]: float(r["r2"]) for r in full if r["model"] == "Lasso"}
    assert shared == pytest.approx(alone, abs=1e-9)


def test_command_line(spark, data, tmp_path):
    assert pipeline.array_job(14, ["A1", "A2", "A3"], ["human", "mouse", "x", "y", "z"]) == ("A3", "z")
    with pytest.raises(ValueError):
        pipeline.array_job(4, ["A1", "A2"], ["human", "mouse"])
    out = str(tmp_path)
    assert pipeline.main(["run", "--data", data, "--out", f"{out}/a", "--ablation", "C1", "--index", "1", "--models", "Lasso"]) == 0
    assert table_of(f"{out}/a/C1/Mouse_4T1_eval_results") and not glob.glob(f"{out}/a/C1/Human*")
    tables = []
    for kind, table in (("cai", CAI), ("tai", TAI)):
        rows = [(c, "X", 0.25, 0.25) for c in SENSE if c in table["human"]]
        tables.append(store.write_csv(spark.createDataFrame(rows, f"codon string, amino_acid string, {kind}_weight_human double, {kind}_weight_mouse double"), f"{out}/{kind}"))
    assert pipeline.main(["run", "--data", data, "--out", f"{out}/b", "--ablation", "C2", "--dataset", "human", "--models", "Lasso", "--weights", *tables]) == 0
    flat = {r["feature"]: float(r["importance"]) for r in table_of(f"{out}/b/C2/Human_HCT116_top_features")}
    assert flat.get("cai", 0.0) == 0.0  # one weight everywhere says nothing
    assert pipeline.main(["run", "--data", data, "--out", f"{out}/c", "--cache-only", "--ablation", "A1"]) == 0 and not glob.glob(f"{out}/c/*")
    assert pipeline.main(["nt", "--data", data, "--out", f"{out}/d", "--embed-only", "--dataset", "human"]) == 0 and not glob.glob(f"{out}/d/*")


def test_embedding_runs_and_their_stored_matrix(spark, data, tmp_path):
    made = []

    def provider():
        return embedding.hashed_kmers(5)

    def build():
        made.append(1)
        return provider

    out = str(tmp_path)
    pipeline.run_embeddings(spark, data, out, "rnafm", "both", ["human"], provider=build(), width=5, models=["Lasso"])
    alone, joint = (table_of(f"{out}/{s}/Human_HCT116_{s}_top_features") for s in ("rnafm", "rnafm_combined"))
    assert len(alone) == 5 and {r["feature"] for r in alone} == {f"rnafm_{i}" for i in range(5)} and len(joint) == 50
    assert embedding.matrix_key("/x/human.parquet", "human", None, "nt", 8) == "human_human_full_nt_hashed_mean_T1000_8"
    paths = glob.glob(f"{store.shared_root(spark)}/matrices/human_human_full_rnafm_mean_L1022_5-*")
    assert len(paths) == 1 and spark.read.parquet(store.committed(spark, paths[0])).count() == 36
    fails = lambda: (_ for _ in ()).throw(AssertionError("embedded again"))
    assert pipeline.run_embeddings(spark, data, out, "rnafm", chosen=["human"], embed_only=True, provider=fails, width=5) == []


def test_published_tables(spark):
    counts = [line.split() for line in golden.RSCU_TEXT.split("\n") if line]
    got = {r["codon"]: r for r in weights.rscu(spark.createDataFrame([(c, int(n)) for c, n, _ in counts], "codon string, count long")).collect()}
    assert len(got) == 61
    for codon, n, rscu in counts:
        assert got[codon]["count"] == int(n) and got[codon]["rscu"] == pytest.approx(float(rscu), abs=5.1e-5) and got[codon]["cai_weight"] == pytest.approx(CAI["human"][codon], abs=5.1e-5)
    copies = [(a, int(n)) for a, n in (line.split() for line in golden.ANTICODON_TEXT.split("\n") if line)]
    tai = {r["codon"]: r["tai_weight"] for r in weights.tai_weights(weights.cleaned_anticodons(spark.createDataFrame(copies, readers.ANTICODONS))).collect()}
    assert tai == pytest.approx(TAI["human"], abs=1e-9)


def test_few_reference_genes_warn(spark):
    said = []
    rows = spark.createDataFrame([(1, "x [gene=RPL3]", "ATGAAATGA"), (2, "y [gene=RPS3A]", "atgaagaaatag"), (3, "z [gene=ACTB]", "ATGAAATGA"), (4, None, None)], "rec_id long, header string, seq string")
    got = {r["codon"]: r["count"] for r in weights.cai_weights(rows, said.append).filter("count > 0").collect()}
    assert got == {"ATG": 2, "AAA": 2, "AAG": 1} and len(said) == 1 and "unreliable" in said[0]


def test_ranks_by_ranges_are_average_ranks(spark):
    rows = [(k, float((i * 7919) % m), float(i % 5)) for k, m, n in (("a", 40, 300), ("b", 900, 200), (None, 3, 10)) for i in range(n)]
    got = metrics.ranked(spark.createDataFrame(rows, "model string, y double, y_hat double"), ["model"], range_rows=11).collect()
    assert len(got) == len(rows)
    for r in got:
        for value, rank in ((1, "ry"), (2, "rp")):
            own = [x[value] for x in rows if x[0] == r["model"]]
            v = r["y" if value == 1 else "y_hat"]
            assert r[rank] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2


def test_matrix_has_the_windows_energies(spark):
    import pandas as pd

    rows = spark.createDataFrame(genes(), SCHEMA)
    windows = {r["gene_id"]: r["u"][-30:] + r["c"][:30] for r in features.with_regions(rows).select("gene_id", F.col("utr5").alias("u"), F.col("cds").alias("c")).collect()}
    got = {r["gene_id"]: r["mfe_start"] for r in features.matrix(rows).collect()}
    assert got == {i: folding.energies(pd.Series([w]))[0] for i, w in windows.items()} and min(got.values()) < 0


def test_large_fasta_equals_whole_files(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_text(">a x>y\r\nAC\r\nGT\r\n>b\nCC\n\n>c\n")
    both = [sorted(tuple(r) for r in read(spark, str(f)).collect()) for read in (readers.fasta, readers.large_fasta)]
    assert both[0] == both[1] == [("a x>y", "ACGT"), ("b", "CC"), ("c", "")]


def test_registered_dictionary():
    assert len(features.PLACE) == 326 and features.classify("gc_full") == ("gc", "full") and features.classify("kozak_score") == ("kozak", "window")
    assert features.classify("cds_NN") == ("di", "cds") and features.classify("utr5_") == features.classify("mystery") == ("unknown", "unknown")


def test_stand_in_predictions_have_every_odd_fold(spark, sf):
    assert X.predictions(spark, sf).filter("model = 'odd'").count() == 7


def test_a_second_read_scans_no_input_and_a_changed_file_misses(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path / "human.parquet"), str(tmp_path / "store")
    spark.createDataFrame(genes(), SCHEMA).write.parquet(path)
    rows = readers.transcripts(spark, path)
    first = store.feature_cache(rows, groups=["gc"], root=root, source=store.snapshot(spark, path, "te"))

    def scanned(*_):
        raise AssertionError("the input was read")

    with monkeypatch.context() as m:
        m.setattr(store, "content", scanned)
        m.setattr(features, "matrix", scanned)
        again = store.feature_cache(rows, groups=["gc"], root=root, source=store.snapshot(spark, path, "te"))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
        with pytest.raises(AssertionError, match="was read"):
            store.feature_cache(rows, groups=["gc"], root=root, source=store.snapshot(spark, path, "other"))
    spark.createDataFrame(genes()[:7], SCHEMA).write.mode("overwrite").parquet(path)
    assert store.feature_cache(readers.transcripts(spark, path), groups=["gc"], root=root, source=store.snapshot(spark, path, "te")).count() == 7


def test_two_builders_of_one_table(spark, tmp_path):
    path = str(tmp_path / "t")

    def late():
        store.stored(spark, path, lambda: spark.range(5))  # another job is first
        return spark.range(9)

    assert store.stored(spark, path, late).count() == 5 and len([d for d in tmp_path.joinpath("t").iterdir() if d.is_dir()]) == 1
    with pytest.raises(Exception, match="broken"):
        store.stored(spark, f"{path}2", lambda: spark.range(3).select(F.raise_error(F.lit("broken"))))
    assert store.committed(spark, f"{path}2") is None and not any(tmp_path.joinpath("t2").iterdir())
    assert store.stored(spark, f"{path}2", lambda: spark.range(3)).count() == 3


def test_combined_counts_while_it_writes(spark):
    a, b = spark.range(10).withColumnRenamed("id", "gene_id"), spark.range(10).selectExpr("id AS gene_id", "id AS v")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("combined-test", "")
    assert embedding.combined(a, b).count() == 10
    writes = len(jobs.getJobIdsForGroup("combined-test"))
    spark.sparkContext.setJobGroup("other", "")
    for left, right in ((a, b.filter("gene_id > 0")), (a.filter("gene_id > 0"), b), (a, b.unionByName(b)), (a, b.withColumn("gene_id", F.col("gene_id") + 1))):
        with pytest.raises(ValueError, match="same rows"):
            embedding.combined(left, right)
    assert writes <= 6  # shuffles of both sides, the write, the read


def test_summary_reads_predictions_once(spark):
    rows = [("m", f, float(i), float(i * i % 7)) for f in (2, 5, 9) for i in range(6)] + [("m", 9, 1.0, 1.0)] + [("k", 1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, fold int, y double, y_hat double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    out = metrics.summary(df.mapInArrow(counted, df.schema), ["model"], strict=False)
    got = {(r["model"], r["fold"]): r for r in out.collect()}
    assert read.value == len(rows) and set(got) == {("m", f) for f in ("0", "1", "2", "mean", "std", "oof")} | {("k", f) for f in ("0", "mean", "std", "oof")}
    assert got["m", "mean"]["mae"] == pytest.approx(sum(got["m", f]["mae"] for f in "012") / 3)
    assert got["k", "mean"]["r2"] is None and got["k", "oof"]["mae"] == 0 and got["k", "mean"]["mae"] == 0
    strict = {(r["model"], r["fold"]): r["r2"] for r in metrics.summary(df, ["model"], strict=True).collect()}
    assert strict["k", "mean"] is None and strict["m", "oof"] == pytest.approx(got["m", "oof"]["r2"])
    with pytest.raises(Exception, match="needs a fold"):
        metrics.summary(df.withColumn("fold", F.when(F.col("y") > 1, F.col("fold"))), ["model"], strict=True).collect()


def test_batches_of_equal_lengths(spark):
    rows = spark.range(1000).select(F.col("id").alias("gene_id"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "AC").otherwise("ACGT").alias("seq"))
    got = {r["gene_id"]: (len(r["seq"] or ""), r["batch"]) for r in embedding.batches(rows, 8, range_rows=70).collect()}
    order = sorted(got, key=lambda i: (-got[i][0], i))
    assert [got[i][1] for i in order] == [i // 8 for i in range(1000)] and embedding.batches(rows.limit(0)).count() == 0


def test_runs_overlap_and_a_failure_leaves_the_others(spark):
    import threading
    import time

    meet, seen = threading.Barrier(2, timeout=60), []

    def slow(batches):
        for b in batches:
            time.sleep(1.5)
            yield b

    def run(name):
        meet.wait()
        spark.range(4).coalesce(1).mapInArrow(slow, "id long").count()
        return [name]

    def watch():
        while threading.active_count() and len(seen) < 400:
            seen.append(len(spark.sparkContext.statusTracker().getActiveJobsIds()))
            time.sleep(0.05)
        return ["watched"]

    def broken():
        raise ValueError("broken run")

    with pytest.raises(ExceptionGroup) as e:
        pipeline.concurrently(spark, {"a": lambda: run("a"), "b": lambda: run("b"), "c": broken, "d": lambda: [seen.extend([0] * 400)] and watch()}, 4)
    assert [str(x) for x in e.value.exceptions] == ["broken run"] and e.value.exceptions[0].__notes__ == ["in run c"]
    del seen[:]
    assert list(pipeline.concurrently(spark, {"a": lambda: run("a"), "b": lambda: run("b"), "w": watch}, 3).values()) == [["a"], ["b"], ["watched"]] and max(seen) >= 2
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_reports_at_once_are_those_of_one_by_one(spark, data, tmp_path, monkeypatch):
    both = [str(tmp_path / d) for d in ("one", "four")]
    for out, n in zip(both, (1, 4), strict=True):
        paths = pipeline.run_ablations(spark, data, out, ["A1", "C1", "B1"], None, ["Lasso", "ElasticNet"], at_once=n)
        assert [p.removeprefix(out) for p in paths] == [f"/{a}/{d}_{r}" for d in ("Human_HCT116", "Mouse_4T1") for a in ("A1", "C1", "B1") for r in ("eval_results.csv", "r2_results.csv", "top_features.csv", "bars.csv", "heatmap.csv", "feature_importance.svg", "model_comparison.svg")]
    names = [p.relative_to(both[0]) for p in tmp_path.joinpath("one").rglob("*.csv")]
    assert len(names) == 30
    for n in names:
        a, b = (table_of(f"{d}/{n}".removesuffix(".csv")) for d in both)
        assert len(a) == len(b) and list(a[0]) == list(b[0])
        for x, y in zip(a, b, strict=True):
            assert all(x[c] == y[c] or float(x[c]) == pytest.approx(float(y[c]), abs=1e-9) for c in x), n
    once = pipeline.report

    def failing(rows, names, models, label, out, *rest):
        if out.endswith("C1"):
            raise ValueError("no disk")
        return once(rows, names, models, label, out, *rest)

    monkeypatch.setattr(pipeline, "report", failing)
    with pytest.raises(ExceptionGroup, match="1 of 2"):
        pipeline.run_ablations(spark, data, str(tmp_path / "f"), ["A1", "C1"], ["human"], ["Lasso"])
    assert len(list(tmp_path.joinpath("f", "A1").glob("[!.]*"))) == 7 and not tmp_path.joinpath("f", "C1").exists()


def test_charts_show_every_row(spark, sf, tmp_path):
    from xml.etree import ElementTree

    from codonlake.operators import charts

    imp = X.importances(spark, sf)
    bars, heat = ([r.asDict() for r in t.collect()] for t in (ranking.bars(imp), ranking.heatmap(imp)))
    drawn = ElementTree.fromstring(charts.bar_chart(bars, "A & <B>"))
    tips = [e.text for e in drawn.iter("{http://www.w3.org/2000/svg}title")]
    assert len(tips) == len(bars) + sum(r["signed_coef"] is not None for r in bars)
    texts = [e.text for e in drawn.iter("{http://www.w3.org/2000/svg}text")]
    assert texts[0] == "Feature importance: A & <B>" and [t for t in texts if ": " in t][1:] == ["Lasso: |coefficient|", "RandomForest: MDI importance", "SVR: drop of R2 when permuted"]
    cells = ElementTree.fromstring(charts.heatmap_chart(heat, "x"))
    assert sum(1 for _ in cells.iter("{http://www.w3.org/2000/svg}title")) == len(heat)
    assert charts.shade(0) == charts.RAMP[0] and charts.shade(1) == charts.RAMP[1] and ElementTree.fromstring(charts.heatmap_chart([], "x")) is not None and ElementTree.fromstring(charts.bar_chart([], "x")) is not None
    path = store.write_file(spark, str(tmp_path / "c" / "x.svg"), charts.bar_chart(bars, "x"))
    assert store.write_file(spark, path, "é") == path and open(path, encoding="utf-8").read() == "é"
