"""The vector cache: interleaved jobs, lost jobs, plans and bytes of look-ups."""

import os

import pytest
from pyspark.sql import functions as F

from codonlake.operators import embedding
from codonlake.sources import vectors
from codonlake.sources.vectors import VectorCache


def rows_of(spark, start, end, shift=0.0):
    return spark.range(start, end).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("seq_hash"), F.array((F.col("id") + shift).cast("float")).alias("embedding"))


def held(cache):
    rows = cache.refresh().table().collect()
    assert len({r["seq_hash"] for r in rows}) == len(rows)
    return {r["seq_hash"]: r["embedding"][0] for r in rows}


def test_interleaved_appends_give_one_row_a_hash(spark, tmp_path):
    root = str(tmp_path / "cache")
    one, two = VectorCache(spark, root, 8), VectorCache(spark, root, 8)
    a, b = one.missing(rows_of(spark, 0, 100)), two.missing(rows_of(spark, 60, 160, 0.5))
    assert a.count() == b.count() == 100  # both stand on the empty cache
    assert one.append(a, "a") == 100 and two.append(b, "b") == 60
    assert one.append(a, "a") == two.append(b, "b") == 0
    third = VectorCache(spark, root)
    assert third.buckets == 8 and third.seen == 2 and held(third) == held(one) and len(held(third)) == 160
    assert third.missing(rows_of(spark, 150, 170)).count() == 10 and third.append(rows_of(spark, 0, 50), "c") == 0
    assert os.listdir(f"{root}/staging") == [] and len(os.listdir(f"{root}/log")) == 2
    values = held(third)
    by_id = {r["seq_hash"]: r["id"] for r in spark.range(160).select("id", F.sha1(F.col("id").cast("string").cast("binary")).alias("seq_hash")).collect()}
    assert all(values[h] == i + (0.5 if i >= 100 else 0.0) for h, i in by_id.items())


def test_a_claim_is_given_once(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "c"))
    assert cache._claimed("log/7", "x") and not cache._claimed("log/7", "y") and cache._read("log/7") == "x" and os.listdir(tmp_path / "c" / "staging") == []


def test_what_a_lost_job_has_left(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    cache = VectorCache(spark, root, 4)
    cache.append(rows_of(spark, 0, 20), "first")

    class LostError(Exception):
        pass

    def lost(self, *names):
        raise LostError

    with monkeypatch.context() as m:  # after the commit
        m.setattr(VectorCache, "_placed", lost)
        with pytest.raises(LostError):
            cache.append(rows_of(spark, 20, 50), "second")
    with monkeypatch.context() as m:  # before the commit
        m.setattr(VectorCache, "_claimed", lost)
        with pytest.raises(LostError):
            VectorCache(spark, root).append(rows_of(spark, 50, 60), "third")
    again = VectorCache(spark, root)
    assert len(held(again)) == 50 and again.seen == 2
    assert again.append(rows_of(spark, 20, 50), "second") == 0 and again.append(rows_of(spark, 40, 60), "third") == 10
    assert len(held(VectorCache(spark, root))) == 60


def bytes_read(df):
    """Bytes of the files that a plan scans, from its metrics, after it has run."""
    df.collect()
    done, todo, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("Scan parquet") and plan.id() not in done:
            done.add(plan.id())
            metric = plan.metrics().get("filesSize")
            total += metric.get().value() if metric.isDefined() else 0
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_look_ups_do_not_exchange_the_cache(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), 16)
    cache.append(rows_of(spark, 0, 4000), "a")
    cache.append(rows_of(spark, 4000, 5000), "b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asking = rows_of(spark, 0, 6000).drop("embedding")
        found = cache.found(asking)
        assert found.count() == 5000
        anti = cache.missing(asking)  # most of the cache is wanted, so the bucketed table is joined
        for df, n in ((found, 5000), (anti, 1000)):
            assert df.count() == n
            assert exchanges_above_scan(df) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges_above_scan(df):
    """Exchanges between the join and the scan of the cache, in the plan that has run."""
    df.collect()
    found = []

    def walk(plan, exchanges):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan(), exchanges)
        if "QueryStage" in name:
            return walk(plan.plan(), exchanges)
        if "Join" in name:
            exchanges = 0
        if name.startswith("Exchange") or name.startswith("BroadcastExchange"):
            exchanges += 1
        if name.startswith("Scan parquet") and "vectors_" in plan.toString():
            found.append(exchanges)
        for i in range(plan.children().size()):
            walk(plan.children().apply(i), exchanges)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    assert found
    return max(found)


def test_filters_skip_files_and_lose_nothing(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "cache"), 32)
    for k in range(3):
        cache.append(rows_of(spark, 3000 * k, 3000 * (k + 1)), f"b{k}")
    whole = sum(os.path.getsize(f"{tmp_path}/cache/data/{n}") for n in os.listdir(f"{tmp_path}/cache/data") if n.endswith(".parquet"))
    for asked, n in ((rows_of(spark, 9000, 9090), 90), (rows_of(spark, 2995, 3000), 0), (rows_of(spark, 8998, 9010), 10), (rows_of(spark, 0, 9000), 0)):
        plain = asked.join(cache.table().select("seq_hash"), "seq_hash", "left_anti")
        got = cache.missing(asked)
        assert sorted(r["seq_hash"] for r in got.collect()) == sorted(r["seq_hash"] for r in plain.select("seq_hash").collect()) and got.count() == n
    new = cache.missing(rows_of(spark, 9000, 9090))  # a hundredth, all new
    assert bytes_read(new) < whole / 10 and bytes_read(rows_of(spark, 9000, 9090).join(cache.table().select("seq_hash"), "seq_hash", "left_anti")) == whole
    assert bytes_read(cache.missing(rows_of(spark, 8998, 9010))) < whole / 10


def test_cached_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "ACGT"), (3, "GG"), (4, None)], "gene_id long, seq string").selectExpr("*", "sha1(seq) AS seq_hash")
    path = str(tmp_path / "cache")
    first = {r["gene_id"]: r["embedding"] for r in embedding.cached_through(rows, path, lambda: embedding.hashed_kmers(4)).collect()}
    fails = lambda: (_ for _ in ()).throw(AssertionError("embedded again"))
    again = {r["gene_id"]: r["embedding"] for r in embedding.cached_through(rows, path, fails).collect()}
    assert first == again and set(first) == {1, 2, 3} and first[1] == first[2] and VectorCache(spark, path).table().count() == 2
    assert vectors.SCHEMA == "seq_hash string, embedding array<float>"
