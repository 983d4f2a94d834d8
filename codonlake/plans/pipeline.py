"""Runs of the whole chain: rows, features, selection, cross-validation, metrics, importances, reports; and its command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import metrics
from codonlake.functions.codons import Tables
from codonlake.operators import ablation, charts, embedding, ranking, validation, weights
from codonlake.sources import readers, store

#: Runs that hand in their jobs at a time.
AT_ONCE = 4
#: Columns that go with the features.
KEPT = ("gene_id", "fold", "te")


@dataclass(frozen=True)
class Dataset:
    path: str
    label: str
    species: str
    target: str


#: Name, label, species and target column of the datasets.
DATASETS = (("human", "Human_HCT116", "human", "TE_HCT116"), ("mouse", "Mouse_4T1", "mouse", "TE_4T1"))


def datasets(spark: SparkSession, root: str) -> dict[str, Dataset]:
    """The datasets below root: NAME.parquet, NAME.csv or NAME.xlsx."""
    out = {}
    for name, label, species, target in DATASETS:
        paths = [f"{root}/{name}.{kind}" for kind in ("parquet", "csv", "xlsx")]
        out[name] = Dataset(next((p for p in paths if store.exists(spark, p)), paths[0]), label, species, target)
    return out


def array_job(index: int, ids: list[str], names: list[str]) -> tuple[str, str]:
    """(ablation, dataset) of a job array's task: ablations first, then datasets."""
    if not 0 <= index < len(ids) * len(names):
        raise ValueError(f"task {index} of {len(ids) * len(names)}")
    return ids[index % len(ids)], names[index // len(ids)]


def prepared(transcripts: DataFrame, spec, species: str | Tables = "human", most: int | None = None, source: str | None = None) -> tuple[DataFrame, list[str]]:
    """Model-ready rows of an ablation; only the groups it names are computed. source: a snapshot of what transcripts come from."""
    rows = ablation.usable(transcripts, most=most)
    s = ablation.as_spec(spec)
    matrix = store.feature_cache(rows, species, list(s.groups), KEPT, source=source and f"{source}-usable-{most}")
    return ablation.prepared(matrix, s)


def evaluate(transcripts: DataFrame, spec, models: list[str], species: str | Tables = "human", scale: float = 1.0, most: int | None = None) -> DataFrame:
    """Metric rows (model, fold, five metrics): each fold, mean, std and pooled."""
    rows, names = prepared(transcripts, spec, species, most)
    return metrics.summary(validation.out_of_fold(rows, names, models, scale), ["model"], strict=False)


def _rows(table: DataFrame) -> list[dict]:
    """The rows of a chart: a few a model."""
    return [r.asDict() for r in table.collect()]


def report(rows: DataFrame, names: list[str], models: list[str], label: str, out: str, scale: float = 1.0, sums: validation.Sums | None = None) -> list[str]:
    """Writes the metric, R2 and top-feature tables, the charts and their data of one run."""
    if set(models) & set(validation.linear.PENALTIES):
        sums = sums or validation.Sums.of(rows, names)
    oof = validation.out_of_fold(rows, names, models, scale, sums).persist()
    dataset, spark = F.lit(label).alias("dataset"), rows.sparkSession
    imp = validation.importances(rows, names, models, scale, sums=sums).persist()
    place = ranking.model_place()
    top = ranking.top_features(imp).select(dataset, "*")
    written = [
        store.write_csv(metrics.summary(oof, ["model"], strict=False).select(dataset, "*"), f"{out}/{label}_eval_results.csv", order=[place, "fold"]),
        store.write_csv(metrics.summary(oof, ["model"], strict=True).select(dataset, "*"), f"{out}/{label}_r2_results.csv", order=[place, "fold"]),
        store.write_csv(top.orderBy(place, "rank").drop("rank"), f"{out}/{label}_top_features.csv"),
        store.write_csv(ranking.bars(imp).select(dataset, "*"), f"{out}/{label}_bars.csv", order=[place, "rank"]),
        store.write_csv(ranking.heatmap_wide(imp, models), f"{out}/{label}_heatmap.csv", order=["feature"]),
        store.write_file(spark, f"{out}/{label}_feature_importance.svg", charts.bar_chart(_rows(ranking.bars(imp)), label)),
        store.write_file(spark, f"{out}/{label}_model_comparison.svg", charts.heatmap_chart(_rows(ranking.heatmap(imp)), label)),
    ]
    oof.unpersist()
    imp.unpersist()
    return written


def concurrently(spark: SparkSession, runs: dict[str, Callable[[], list[str]]], at_once: int = AT_ONCE) -> dict[str, list[str]]:
    """What each run returns, by name. Up to `at_once` runs hand in their jobs at a time, each in a pool of its own, so that
    with spark.scheduler.mode=FAIR none waits for another's tasks. A run that fails leaves the others; when all have ended,
    the failures are raised together.
    """

    def one(name: str) -> list[str]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return runs[name]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    done, failed = {}, []
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(one), name) for name in runs}
        for name, future in futures.items():
            try:
                done[name] = future.result()
            except Exception as e:
                e.add_note(f"in run {name}")
                failed.append(e)
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(runs)} runs failed", failed)
    return done


def run_ablations(
    spark: SparkSession, root: str, out: str, ids: list[str] | None = None, which: list[str] | None = None, models: list[str] | None = None, cache_only: bool = False, scale: float = 1.0,
    weight_paths: tuple[str, str] | None = None, at_once: int = AT_ONCE,
) -> list[str]:
    """Reports of all (dataset, ablation) below out/ABLATION, `at_once` of them at a time. The groups that any of them names are
    computed once a dataset, and one pass of cross products serves the linear models of all of them. weight_paths: combined
    CAI and tAI tables of one's own.
    """
    specs = {i: ablation.ABLATIONS[i] for i in ids or list(ablation.ABLATIONS)}
    groups = sorted({g for s in specs.values() for g in s.groups})
    models = models or list(validation.MODELS)
    chosen = {name: d for name, d in datasets(spark, root).items() if not which or name in which}

    def matrix(d: Dataset) -> DataFrame:
        rows = ablation.usable(readers.transcripts(spark, d.path, d.target))
        species = readers.weight_tables(spark, *weight_paths, d.species) if weight_paths else d.species
        return store.feature_cache(rows, species, groups, KEPT, source=store.snapshot(spark, d.path, d.target))

    matrices = {name: matrix(d) for name, d in chosen.items()}
    if cache_only:
        return []
    linear = bool(set(models) & set(validation.linear.PENALTIES))
    sums = {name: validation.Sums.of(*ablation.prepared(m, groups)) if linear else None for name, m in matrices.items()}

    def run(name: str, aid: str) -> list[str]:
        ready, names = ablation.prepared(matrices[name], specs[aid])
        return report(ready, names, models, chosen[name].label, f"{out}/{aid}", scale, sums[name])

    runs = {f"{name}/{aid}": partial(run, name, aid) for name in chosen for aid in specs}
    return [path for paths in concurrently(spark, runs, at_once).values() for path in paths]


def run_embeddings(
    spark: SparkSession, root: str, out: str, source: str, which: str = "both", chosen: list[str] | None = None, embed_only: bool = False, provider=None, width: int = 64, models: list[str] | None = None,
    scale: float = 1.0, most: int | None = None,
) -> list[str]:
    """Embedding features alone and joined with all hand-made ones. source: rnafm or nt. The matrix of a dataset's vectors
    is stored under its key, with the contents it was made of, and read when both are the same.
    """
    written = []
    provider = provider or (lambda: embedding.hashed_kmers(width))
    for name, d in datasets(spark, root).items():
        if chosen and name not in chosen:
            continue
        rows = ablation.usable(readers.transcripts(spark, d.path, d.target), most=most)
        raw = F.col("tx_sequence")
        key, seq = (embedding.rnafm_key(raw), embedding.rnafm_input(raw)) if source == "rnafm" else (embedding.nt_key(raw, "hashed"), embedding.nt_input(raw))
        keyed = rows.select(*KEPT, key.alias("seq_hash"), seq.alias("seq"))

        def vectors(keyed: DataFrame = keyed) -> DataFrame:
            found = embedding.cached_through(keyed, f"{store.shared_root(spark)}/embeddings/{source}-{width}", provider)
            return embedding.unstacked(found.select(*KEPT, "embedding"), source, width)

        path = f"{store.shared_root(spark)}/matrices/{embedding.matrix_key(d.path, d.species, most, source, width)}-{store.content(keyed, *KEPT, 'seq_hash')}"
        wide = store.stored(spark, path, vectors)
        if embed_only:
            continue
        own = [c for c in wide.columns if c.startswith(f"{source}_")]
        for label in embedding.feature_sets(which, source):
            if label == source:
                ready, names = wide, own
            else:
                hand, features = prepared(rows, None, d.species)
                ready, names = embedding.combined(hand, wide.select("gene_id", *own)), features + own
            written += report(ready, names, models or list(validation.MODELS), f"{d.label}_{label}", f"{out}/{label}", scale)
    return written


def build_cai(spark: SparkSession, fasta: dict[str, str], out: str) -> str:
    tables = {}
    for species, path in fasta.items():
        records = readers.fasta(spark, path).withColumn("rec_id", F.monotonically_increasing_id())
        checked = weights.checked(records)
        store.write_csv(checked.filter("reference").select("gene", F.length("seq").alias("length_nt"), "header"), f"{out}/{species}/reference_genes.tsv", sep="\t")
        full = weights.cai_weights(records)
        store.write_csv(full.drop("cai_weight"), f"{out}/{species}/rscu_table.csv", order=["codon"])
        store.write_csv(full.select("codon", "amino_acid", "cai_weight"), f"{out}/{species}/cai_weights.csv", order=["codon"])
        tables[species] = readers.table(spark, f"{out}/{species}/cai_weights.csv", readers.CAI_SPECIES).select("codon", "cai_weight")
    return store.write_csv(weights.merged(tables, "cai"), f"{out}/combined_cai_weights.csv", order=["codon"])


def build_tai(spark: SparkSession, fasta: dict[str, str], out: str) -> str:
    tables = {}
    for species, path in fasta.items():
        counts = weights.anticodons_of(readers.lines(spark, path))
        if counts.isEmpty():
            raise ValueError(f"no anticodons found in {path}")
        store.write_csv(counts, f"{out}/{species}_trna_gene_counts.csv", order=["anticodon"])
        own = store.write_csv(weights.tai_weights(weights.cleaned_anticodons(counts)), f"{out}/{species}_tai_weights.csv", order=["codon"])
        tables[species] = readers.table(spark, own, readers.TAI_SPECIES)
    return store.write_csv(weights.merged(tables, "tai"), f"{out}/combined_tai_weights.csv", order=["codon"])


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="codonlake")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="ablations")
    run.add_argument("--ablation", choices=list(ablation.ABLATIONS))
    run.add_argument("--cache-only", action="store_true")
    run.add_argument("--weights", nargs=2, metavar=("CAI", "TAI"), help="combined weight tables in the place of the built-in ones")
    run.add_argument("--at-once", type=int, default=AT_ONCE, help="runs whose jobs may overlap")
    run.add_argument("--index", type=int, help="task of a job array over (ablation, dataset)")
    for source in ("rnafm", "nt"):
        one = sub.add_parser(source, help=f"{source} embeddings")
        one.add_argument("--features", choices=[source, "combined", "both"], default="both")
        one.add_argument("--embed-only", action="store_true")
    for p in sub.choices.values():
        p.add_argument("--dataset", choices=["human", "mouse"])
        p.add_argument("--data", required=True)
        p.add_argument("--scale", type=float, default=1.0)
        p.add_argument("--models", nargs="*", choices=validation.MODELS)
    for name in ("build-cai", "build-tai"):
        one = sub.add_parser(name)
        one.add_argument("--fasta", nargs=2, metavar=("HUMAN", "MOUSE"), required=True)
    for p in sub.choices.values():
        p.add_argument("--out", required=True)
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    which = [a.dataset] if getattr(a, "dataset", None) else None
    if a.command == "run":
        ids = [a.ablation] if a.ablation else None
        if a.index is not None:
            one, name = array_job(a.index, ids or list(ablation.ABLATIONS), which or [d[0] for d in DATASETS])
            ids, which = [one], [name]
        run_ablations(spark, a.data, a.out, ids, which, a.models, a.cache_only, a.scale, tuple(a.weights) if a.weights else None, a.at_once)
    elif a.command in ("rnafm", "nt"):
        run_embeddings(spark, a.data, a.out, a.command, a.features, which, a.embed_only, models=a.models, scale=a.scale)
    else:
        {"build-cai": build_cai, "build-tai": build_tai}[a.command](spark, dict(zip(("human", "mouse"), a.fasta, strict=True)), a.out)
    return 0
