"""Stores that grow by runs: nothing is lost, nothing counts twice, and little is read."""

import datetime as dt
import hashlib
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from speechjobs.operators import totals
from speechjobs.plans import store_queries
from speechjobs.sources import seen
from speechjobs.sources.runs import RunLog
from speechjobs.sources.seen import SeenStore
from speechjobs.streaming import feeds
from test_ingest import APP, N, SET, document, take, uuid


def digests(*numbers):
    return [hashlib.sha256(str(n).encode()).hexdigest()[:24] for n in numbers]


def frame(spark, names):
    return spark.createDataFrame([(d,) for d in names], "digest string")


def test_filters_pass_all_of_their_own_and_few_others():
    own, others = digests(*range(3000)), digests(*range(10_000, 40_000))
    bloom = seen.filter_of(own)
    assert seen.may_hold(bloom, own).all() and seen.may_hold(bloom, others).mean() < 0.03
    assert not seen.may_hold(seen.filter_of([]), own).any()


def test_a_look_up_reads_only_parts_that_may_hold_an_id(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "seen"))
    assert store.known(frame(spark, digests(1))).collect() == []
    store.add(frame(spark, digests(*range(400))), 1)
    store.add(frame(spark, digests(*range(300, 500))), 2)
    asked = digests(7, 450, 9000, 9001)
    found = store.known(frame(spark, [*asked, None, asked[0]]))
    assert {r.digest for r in found.collect()} == set(asked[:2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([^)]*)\)", plan)
    assert read and all({d[:2] for d in asked[:2]} <= set(r.split(",")) and len(r.split(",")) <= 4 for r in read)
    assert {r.digest for r in store.known(frame(spark, asked), before=2).collect()} == set(asked[:1])


def test_a_run_replaces_itself_and_one_that_broke_off_counts_for_nothing(spark, tmp_path):
    path = tmp_path / "seen"
    store = SeenStore(spark, str(path))
    store.add(frame(spark, digests(1, 2)), 1)
    store.add(frame(spark, digests(3)), 1)
    store.add(frame(spark, digests(4)), 2)
    next((path / "ids").glob("run=000000002-*/_SUCCESS")).unlink()
    assert {r.digest for r in store.known(frame(spark, digests(1, 2, 3, 4))).collect()} == set(digests(3))
    store.add(frame(spark, digests(4, 5)), 2)
    store.add(frame(spark, []), 3)
    store.compact()
    assert len(list((path / "ids").iterdir())) == len(list((path / "filters").iterdir())) == 1
    store.add(frame(spark, digests(6)), 4)
    assert {r.digest for r in store.known(frame(spark, digests(*range(9)))).collect()} == set(digests(3, 4, 5, 6))


def test_ranges_stand_for_the_runs_inside(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), "x long")
    assert log.last() is None and log.read().count() == 0
    for run in range(4):
        log.write(spark.range(run).withColumnRenamed("id", "x"), run)
    log.write(spark.range(100, 103).withColumnRenamed("id", "x"), 0, 2)
    assert sorted(log.folders()) == [(0, 2), (3, 3)] and log.read().count() == 6 and log.last() == 3
    assert sorted(log.folders(before=3)) == [(0, 2)]
    log.drop_replaced()
    assert log.names("run=*") == ["run=000000000-000000002", "run=000000003-000000003"]


def test_takes_count_once_over_all_batches(spark, tmp_path):
    """Files arrive over several streams; a stream that starts again from its first file changes nothing."""
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    (files / "a.json").write_text(document(*[take(i % 5) for i in range(8)], take(50, id="bad")))
    fold = feeds.fold_takes(store, SET, N)
    batches = []

    def run(name):
        stream = feeds.takes_stream(spark, str(files), APP, SET, N)
        stream.writeStream.foreachBatch(lambda b, n: (batches.append(n), fold(b, n))).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    run("c")
    (files / "b.json").write_text(document(*[take(i, contributor=uuid(2, "c000")) for i in range(3, 9)]))
    run("c")
    found = lambda: {r.key: (r["count"], r.total[0]) for r in totals.TotalsLog(spark, f"{store}/totals", SET).total().collect()}
    assert batches == [0, 1] and found() == {"GB": (9, 4.5), "GB-SCT": (9, 4.5)}
    # the last batch once more, as after a driver that died behind its writes
    again = spark.read.option("wholetext", True).text(str(files / "b.json")).select(F.lit("b").alias("path"), "value")
    takes = feeds.check_takes(feeds.parse_files(again, APP)[0], SET, N)
    where = F.when(F.col("reason").isNull(), feeds.route(F.col("country"), F.col("region"), F.col("target_accent"), F.col("natural_voice")))
    fold(takes.withColumns({"route": where, "digest": feeds.digest(F.col("id"))}), 1)
    assert found() == {"GB": (9, 4.5), "GB-SCT": (9, 4.5)}


def test_merging_adds_matrices_in_two_levels(spark):
    rng = np.random.default_rng(0)
    rows = [("k", "ab"[i % 2], rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "kind string, key string, features array<double>").repartition(7)
    merged = totals.totals_of(df, 3)
    for r in merged.collect():
        x = np.array([v for _, k, v in rows if k == r.key])
        assert r["count"] == len(x) and np.allclose(r.total, x.sum(0)) and np.allclose(np.array(r.outer).reshape(3, 3), x.T @ x)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FlatMapGroupsInArrow") == 2 and "Generate" not in plan


def test_day_state_does_not_grow_with_learners(spark, tmp_path):
    """An open day of many learners is a few values of state; late rows, learners without an id and rows without a time count too."""
    rocks = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(rocks, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    at = lambda day: F.timestamp_seconds(F.lit(day).cast("long") * 86_400 + 60)
    rows = lambda n, day: spark.range(n).select(F.nullif("id", F.lit(7)).alias("user_id"), at(day).alias("timestamp"), F.lit("real").alias("source"))
    steps = [rows(300, 100).union(rows(300, 101)).union(rows(100, 101)), rows(1, 120), rows(50, 100).union(rows(2, None)), rows(1, 140)]
    kept = []
    try:
        for step in steps:
            step.write.mode("append").parquet(folder)
            stream = feeds.day_stream(spark.readStream.schema(step.schema).parquet(folder))
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()
            q.awaitTermination()
            kept.append(q.recentProgress[0].stateOperators[0].numRowsTotal)
    finally:
        spark.conf.unset(rocks)
    found = spark.read.parquet(out)
    got = {(r.user_id, r.day and (r.day - dt.date(1970, 1, 1)).days): r.n for r in found.groupBy("user_id", "day").agg(F.sum("attempts").alias("n")).collect()}
    ids = [None if i == 7 else i for i in range(300)]
    want = {(u, 100): 2 if i < 50 else 1 for i, u in enumerate(ids)} | {(u, 101): 2 if i < 100 else 1 for i, u in enumerate(ids)} | {(0, 120): 1} | {(u, None): 1 for u in ids[:2]}
    assert got == want and found.filter("late").agg(F.sum("attempts")).first()[0] == 52
    # two days of 128 buckets and one of the learners without an id: a value and the two entries of a timer each
    assert kept[0] <= 2 * 129 * 3


def test_export_files_lie_in_one_folder(spark, tmp_path):
    """As many files as documents, and no folder for each of them, which a stream would have to list."""
    vectors = spark.range(500).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i / 64).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    folder = Path(store_queries._export_folder(spark, str(tmp_path)).removeprefix("file:"))
    texts = [f.read_text() for f in folder.glob("*.txt")]
    assert len(texts) == 10 and all(t.count('"app"') == 1 for t in texts) and not any(f.is_dir() for f in folder.iterdir())
