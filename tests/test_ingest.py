import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechjobs.operators import ingest, totals
from speechjobs.sources import exports
from speechjobs.streaming import feeds

APP, SET, N = "speechapp", "m1", 4


def uuid(n, head="0000"):
    return f"{n:08x}-{head}-4000-8000-000000000000"


def take(n=1, **changed):
    base = {"id": uuid(n), "contributor": uuid(1, "c000"), "country": "GB", "region": "SCT", "target_accent": None, "natural_voice": True, "matches_home_accent": False, "model_version": SET, "features": [0.5, 1.0, -2.0, 3]}
    out = base | changed
    return {k: v for k, v in out.items() if v != "absent"}


def document(*takes, **changed):
    return json.dumps({"app": APP, "kind": "contributions", "version": 2, "exported": "2024-01-01", "takes": list(takes)} | changed)


def checked_of(spark, folder, **files):
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body)
    takes, skipped = exports.parse_files(exports.read_files(spark, str(folder)), APP)
    return exports.check_takes(takes, SET, N), skipped


REFUSALS = [
    ({"id": "x"}, "bad take id"), ({"id": 7}, "bad take id"), ({"id": "absent"}, "bad take id"), ({"contributor": "me"}, "bad contributor id"), ({"contributor": None}, "bad contributor id"),
    ({"country": "GBR"}, "bad country"), ({"country": 44}, "bad country"), ({"country": ""}, "bad country"), ({"region": "NE"}, "bad region"), ({"region": ""}, "bad region"), ({"region": 3}, "bad region"),
    ({"natural_voice": "yes"}, "bad labels"), ({"natural_voice": 1}, "bad labels"), ({"matches_home_accent": None}, "bad labels"), ({"target_accent": "rp"}, "bad target accent"),
    ({"natural_voice": False, "target_accent": None}, "bad target accent"), ({"natural_voice": False, "target_accent": "fr"}, "bad target accent"), ({"matches_home_accent": True}, "labels disagree"),
    ({"natural_voice": False, "target_accent": "rp", "matches_home_accent": False}, "labels disagree"), ({"model_version": "m0"}, "made with a different model version"), ({"model_version": 1}, "made with a different model version"),
    ({"features": [1, 2, 3]}, "wrong feature length"), ({"features": None}, "wrong feature length"), ({"features": "1234"}, "wrong feature length"), ({"features": [1, 2, 3, "4"]}, "non-finite feature"),
    ({"features": [1, 2, 3, True]}, "non-finite feature"), ({"features": [1, 2, 3, None]}, "non-finite feature"), ({"features": [1, 2, 3, 61]}, "feature out of range"), ({"country": "gb"}, None), ({"region": None}, None), ({}, None),
    ({"natural_voice": False, "target_accent": "rp", "matches_home_accent": True}, None), ({"id": uuid(9).upper()}, None),
]


def test_refusals(spark, tmp_path):
    body = document(*[take(i, **change) for i, (change, _) in enumerate(REFUSALS)], 5, "x", [1])
    checked, skipped = checked_of(spark, tmp_path, a=body)
    got = {r.pos: r.reason for r in checked.collect()}
    assert [got[i] for i in range(len(REFUSALS))] == [reason for _, reason in REFUSALS]
    assert [got[len(REFUSALS) + i] for i in range(3)] == ["not a take"] * 3 and skipped.count() == 0


def test_bare_nan_and_skipped_files(spark, tmp_path):
    nan = document(take(1)).replace("-2.0", "NaN")
    checked, skipped = checked_of(spark, tmp_path, a=nan, b="{", c="[]", d=document(app="other"), e=document(version=1), f=document(takes=3), g=document(version="2"), h=document(take(2)))
    assert sorted(r.reason or "" for r in checked.collect()) == ["", "non-finite feature"]
    assert sorted(r.reason for r in skipped.collect()) == ["invalid json"] + ["unrecognised file"] * 5


def walked(rows, cap, seen=()):
    seen, used, out = set(seen), {}, []
    for path, pos, digest, who in sorted(rows):
        if digest in seen:
            out.append("duplicate")
        elif used.get(who, 0) >= cap:
            out.append("over_cap")
        else:
            seen.add(digest)
            used[who] = used.get(who, 0) + 1
            out.append("added")
    return out


@pytest.mark.parametrize("shared", [False, True])
def test_statuses_equal_a_walk(spark, shared):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        n = int(rng.integers(40))
        rows.append((f"{rng.integers(3)}.json", i, uuid(n), uuid(int(rng.integers(4)) if shared else n % 4, "c000")))
    checked = spark.createDataFrame([(p, i, None, d, c) for p, i, d, c in rows], "path string, pos int, reason string, id string, contributor string")
    old = [uuid(3)]
    seen = spark.createDataFrame([(x,) for x in old], "id string").select(ingest.digest(F.col("id")).alias("digest"))
    got = [r.status for r in ingest.judge(checked, seen, 5).orderBy("path", "pos").collect()]
    assert got == walked(rows, 5, old)
    chained = [(f"{i % 3}.json", i, uuid(i // 2), uuid((i + 1) // 2 % 9, "c000")) for i in range(40)]  # each shares an id with the next
    checked = spark.createDataFrame([(p, i, None, d, c) for p, i, d, c in chained], "path string, pos int, reason string, id string, contributor string")
    assert [r.status for r in ingest.judge(checked, seen, 2).orderBy("path", "pos").collect()] == walked(chained, 2, old)


def test_ingest_rebuild_and_dry_run(spark, tmp_path):
    store = str(tmp_path / "store")
    files = tmp_path / "files"
    files.mkdir()
    checked, skipped = checked_of(spark, files, a=document(take(1), take(2, region=None), take(1)), b=document(take(3, natural_voice=False, target_accent="ga", region=None, contributor=uuid(2, "c000"))))
    dry = ingest.ingest(spark, checked, skipped, store, SET, N, 0, dry_run=True)
    assert {(r.kind, r.key): r["count"] for r in dry.totals.collect()} == {("native", "GB"): 2, ("native", "GB-SCT"): 1, ("attempt", "GB>ga"): 1}
    assert not (tmp_path / "store").exists()
    ingest.ingest(spark, checked, skipped, store, SET, N, 0)
    again = ingest.ingest(spark, checked, skipped, store, SET, N, 1)
    assert {r.status: r.takes for r in ingest.status_counts(again.judged).collect()} == {"duplicate": 4}
    assert {(r.kind, r.key): r["count"] for r in again.totals.collect()}["native", "GB"] == 2
    (files / "b.json").unlink()
    takes, skipped = exports.parse_files(exports.read_files(spark, str(files)), APP)
    rebuilt = ingest.ingest(spark, exports.check_takes(takes, SET, N), skipped, store, SET, N, 2, rebuild=True)
    assert {(r.kind, r.key) for r in rebuilt.totals.collect()} == {("native", "GB"), ("native", "GB-SCT")}
    row = ingest.ingest_summary(rebuilt, SET, rebuilt=True).first()
    assert (row.added, row.duplicates, row.added_native, row.added_attempts, row.countries[0].country) == (2, 1, 2, 0, "GB")
    with pytest.raises(ValueError, match="start a new totals store"):
        totals.load_totals(spark, f"{store}/v1/totals", "m2")


def test_audit_and_export_round_trip(spark, tmp_path):
    body = document(take(1), take(2, wav="x"))
    (tmp_path / "a.json").write_text(body)
    takes, _ = exports.parse_files(exports.read_files(spark, str(tmp_path)), APP)
    found = {r.pos: r for r in exports.audit(exports.check_takes(takes, SET, N), takes).collect()}
    assert found[0].route.keys == ["GB", "GB-SCT"] and not found[0].holds_audio and found[1].holds_audio
    rows = spark.createDataFrame([(uuid(1), "2024", uuid(1, "c000"), "GB", "SCT", None, True, False, SET, [1.0, 2.0, 3.0, 4.0])], "id string, created string, contributor string, country string, region string, target_accent string, natural_voice boolean, matches_home_accent boolean, model_version string, features array<double>")
    out = tmp_path / "out.json"
    out.write_text(exports.export_document(rows, APP, "2024").first().value)
    takes, _ = exports.parse_files(exports.read_files(spark, str(out)), APP)
    assert [r.reason for r in exports.check_takes(takes, SET, N).collect()] == [None]


def vectors(spark, n=200, f=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("native", k, (rng.normal(size=f) + i * 2).tolist()) for i, k in enumerate("ABC") for _ in range(n)]
    return spark.createDataFrame(rows, "kind string, key string, features array<double>"), rows


def test_totals_do_not_depend_on_the_split(spark):
    df, rows = vectors(spark)
    whole = {r.key: r for r in totals.totals_of(df, 5).collect()}
    parts = {r.key: r for r in totals.merge_totals(*[totals.totals_of(df.filter(F.pmod(F.hash("features"), F.lit(3)) == i), 5) for i in range(3)]).collect()}
    for k in "ABC":
        x = np.array([r[2] for r in rows if r[1] == k])
        assert whole[k]["count"] == parts[k]["count"] == 200
        np.testing.assert_allclose(whole[k].outer, (x.T @ x).ravel())
        np.testing.assert_allclose(parts[k].outer, whole[k].outer)
        np.testing.assert_allclose(parts[k].total, x.sum(0))


def test_classifier_equals_direct_fit(spark):
    df, rows = vectors(spark)
    model = totals.fit_classifier(totals.totals_of(df, 5))
    xs = {k: np.array([r[2] for r in rows if r[1] == k]) for k in "ABC"}
    scatter = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in xs.values()) / (600 - 3)
    scatter += np.eye(5) * 1e-3 * np.trace(scatter) / 5
    np.testing.assert_allclose(model.precision, np.linalg.inv(scatter))
    assert [keys for keys, _ in model.blocks()] == [["A", "B", "C"]] and totals.fit_classifier(totals.totals_of(df.filter("key = 'A'"), 5)) is None
    hit = totals.classify(df, model).agg(F.avg((F.col("key") == F.col("prediction")).cast("int"))).first()[0]
    assert hit > 0.9
    far = totals.mean_distances(totals.totals_of(df, 5), model, 5).filter("key = 'A' and accent = 'B'").first().distance
    away = xs["A"] - xs["B"].mean(0)
    assert far == pytest.approx(np.einsum("nf,fg,ng->n", away, model.precision, away).mean())


def test_means_in_blocks(spark):
    """Twelve keys, two or all at a time; ties go to the first key, null vectors have none."""
    rng = np.random.default_rng(3)
    rows = [(i, "k", f"{i % 12:02d}", (rng.normal(size=4) + i % 12).tolist()) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, "k", "00", None)], "old long, kind string, key string, features array<double>")
    t = totals.totals_of(df.filter("features is not null"), 4)
    twin = t.filter("key = '03'").withColumn("key", F.lit("99"))
    model = totals.fit_classifier(t.unionByName(twin).unionByName(twin.withColumn("key", F.lit(None).cast("string"))))
    assert [k for keys, _ in model.blocks(5) for k in keys] == [f"{i:02d}" for i in range(12)] + ["99"]
    whole = {r.old: r.new for r in totals.classify(df, model, name="new").collect()}
    assert {r.old: r.new for r in totals.classify(df, model, name="new", keys_at_once=1).collect()} == whole
    assert whole[600] is None and "03" in whole.values() and "99" not in whole.values()


@pytest.mark.parametrize(("dims", "keep"), [(12, 3), (90, 4)])
def test_projection_equals_a_decomposition(spark, dims, keep):
    """With the whole space, and with a part of it where the singular values fall off."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims)) * 0.3 + (rng.normal(size=(400, 6)) * [9, 7, 5, 3, 2, 1]) @ rng.normal(size=(6, dims)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(400, None)], "id long, stats array<double>").repartition(5)
    p = totals.fit_projection(df, dims, keep)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    right = np.linalg.svd(z, full_matrices=False)[2][:keep].T
    right = right * np.sign(right[np.abs(right).argmax(0), np.arange(keep)])
    np.testing.assert_allclose(p.directions, right, atol=1e-6)
    turned = {r.id: r.features for r in totals.project(df, p).collect()}
    assert turned.pop(400) is None
    np.testing.assert_allclose([turned[i] for i in range(400)], z @ right, atol=1e-4)
    with pytest.raises(ValueError, match="no vectors"):
        totals.fit_projection(df.filter("id = 400"), dims, keep)


def test_reports(spark):
    df, _ = vectors(spark)
    t = totals.totals_of(df, 5)
    people = spark.createDataFrame([("A", 9), ("B", 2)], "country string, contributors long")
    report = {r.key: r for r in totals.place_report(t, people, 8, 100).collect()}
    assert report["A"].ready and not report["B"].ready and report["C"].enough_contributors is None and report["C"].ready
    groups = t.filter("key = 'A'").withColumn("key", F.lit("GB>B"))
    row = totals.landing_report(groups, t, 5).first()
    assert (row.kind, row.target, row.closest, row.lands_on_target) == ("attempt", "B", "A", False)
    assert totals.landing_report(groups, t.filter("key = 'A'"), 5) is None
    p = totals.fit_projection(df.withColumnRenamed("features", "stats"), 5, 2)
    assert len(totals.project(df, p, "features", "small").first().small) == 2


def test_streams_agree_with_batch(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.json").write_text(document(*[take(i % 7) for i in range(12)]))
    stream = feeds.takes_stream(spark, str(files), APP, SET, N).filter("reason is null")
    out = []
    q = stream.writeStream.foreachBatch(lambda b, n: out.extend(feeds.once_forever(b, spark.createDataFrame([], "digest string")).collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) == 7 and {r.route.kind for r in out} == {"native"}
    q = feeds.capped(feeds.takes_stream(spark, str(files), APP, SET, N).filter("reason is null"), 5).writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("capped").count() == 5


def test_streak_feed_and_daily_stream(spark, tmp_path):
    from speechjobs.operators import history

    rng = np.random.default_rng(0)
    rows = [(i, i % 3, float(rng.integers(5, 11)), f"2024-01-{1 + i // 30:02d} 10:00:00", "real") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, user_id long, score double, ts string, source string").withColumn("timestamp", F.to_timestamp("ts")).drop("ts")
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    q = feeds.streak_feed(read()).writeStream.format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r.id: r.streak for r in history.streaks(df).collect()}
    assert {r.id: r.streak for r in spark.table("streaks").collect()} == batch
    q = feeds.daily_stream(read()).writeStream.outputMode("update").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.day): r.attempts for r in spark.table("days").collect()} == {(r.user_id, r.day): r.attempts for r in history.daily_counts(df).collect()}


def test_running_totals_are_idempotent(spark, tmp_path):
    df, _ = vectors(spark, 20, 3)
    fold = feeds.fold_batches(str(tmp_path / "s"), SET, 3)
    fold(df.filter("key = 'A'"), 0)
    fold(df.filter("key <> 'A'"), 1)
    fold(df.filter("key <> 'A'"), 1)
    log = totals.TotalsLog(spark, str(tmp_path / "s"), SET)
    assert {r.key: r["count"] for r in log.total().collect()} == dict.fromkeys("ABC", 20)
    with pytest.raises(ValueError, match="start a new totals store"):
        totals.TotalsLog(spark, str(tmp_path / "s"), "m2").total()


def test_held_out_check_and_reference(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{a}{s}", a, part, i, (rng.normal(size=4) + k * 3).tolist()) for k, a in enumerate("xy") for s in range(8) for part in ("window", "clip") for i in range(6)]
    df = spark.createDataFrame(rows, "speaker_id string, accent string, part string, seq int, features array<double>")
    got = {r.part: r for r in totals.held_out_check(df, 4).collect()}
    assert got["window"].classes == 2 and got["clip"].balanced_accuracy > 0.9
    stats = df.withColumnRenamed("features", "stats").drop("accent")
    speakers = df.select("speaker_id", "accent").distinct()
    made = totals.reference_totals(stats, speakers, {"ga": "x"}, totals.fit_projection(stats, 4, 2), 2).collect()
    assert [(r.kind, r.key, r["count"], len(r.outer)) for r in made] == [("reference", "ga", 96, 4)]
