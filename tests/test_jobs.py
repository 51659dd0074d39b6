import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechjobs.operators import cohorts, evaluation, frames, history, lexicon


def attempts(spark):
    e = lambda *xs: [("substitute", i, [x], ["S"], "t") for i, x in xs]
    rows = [
        (1, 1, "thin", "ga", ["TH", "IH1", "N"], ["S", "IH1", "N"], 6.0, 0.3, e((0, "TH")), "2024-01-01 10:00:00", "real"), (2, 1, "thin", "ga", ["TH", "IH1", "N"], ["S", "IH1", "N"], 7.0, 0.3, e((0, "TH")), "2024-01-01 11:00:00", "real"),
        (3, 1, "ship", "ga", ["SH", "IH1", "P"], ["SH", "IH1", "P"], 9.0, 0.0, [], "2024-01-02 10:00:00", "real"), (4, 1, "ship", None, ["SH", "IH1", "P"], ["SH", "IH1", "P"], 9.0, 0.0, [], "2024-01-02 11:00:00", "sample"),
    ]
    df = spark.createDataFrame(rows, history.ATTEMPT.replace("timestamp timestamp", "timestamp string"))
    return df.withColumn("timestamp", F.to_timestamp("timestamp"))


def test_insights(spark):
    a = attempts(spark).withColumn("accent", F.lit("ga"))
    found = history.insights(a)
    rows = {r.sound: r for r in found.collect()}
    assert (rows["TH"].attempts, rows["TH"].errors, rows["TH"].error_rate, rows["IH"].attempts, rows["IH"].errors) == (2, 2, 1.0, 4, 0)
    weak = history.weak_sounds(found)
    assert [r.sound for r in weak.collect()] == ["TH"]
    bank = spark.createDataFrame([("think", 1, ["TH", "IH1", "NG", "K"]), ("ship", 2, ["SH", "IH1", "P"])], "word string, seq int, phonemes array<string>")
    assert [(r.word, r.focus) for r in history.recommend_words(weak, bank).collect()] == [("think", ["TH"])]


def test_history_numbers(spark):
    a = attempts(spark)
    stats = history.history_stats(a).first()
    assert (stats.attempts, stats.average, stats.best_id) == (4, 7.75, 4)
    assert tuple(history.most_improved(a).first())[1:] == ("thin", 1.0)
    assert [r.streak for r in history.streaks(a).orderBy("id").collect()] == [0, 0, 1, 2]
    assert sorted(r.attempts for r in history.daily_counts(a).collect()) == [1, 2]
    assert history.scope(a, "ga", "high", "real").count() == 1 and history.cleared(a, "sample").count() == 3 and history.cleared(a).count() == 0
    assert [r.id for r in history.newest(a, 2).collect()] == [4, 3]
    assert [m.status for m in history.marks(a).filter("id = 1").first().marks] == ["error", "correct", "correct"]
    assert history.seed_if_empty(a.limit(0), a).filter("source = 'sample'").count() == 4


def test_history_files(spark, tmp_path):
    a = attempts(spark)
    history.write_csv(a, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"TH IH1 N"' in text and '"word"' in text
    history.append_attempts(a, str(tmp_path / "t"))
    history.append_attempts(a, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8
    good = {"word": "new", "timestamp": "2024-01-05 10:00:00", "score": 5, "wer": 0.1, "target_phonemes": ["K"], "predicted_phonemes": ["K"], "errors": []}
    (tmp_path / "good.json").write_text(json.dumps({"attempts": [good, good, good | {"word": "thin", "timestamp": "2024-01-01 10:00:00"}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"attempts": [good, {"word": 3}]}))
    rows, rejected = history.import_backup(spark, str(tmp_path / "*.json"), a)
    assert [r.word for r in rows.collect()] == ["new", "new"] and rejected.count() == 1


def test_lexicon(spark):
    lines = lexicon.dictionary_lines(spark.createDataFrame([("DANCE, d ˈɑː n s\nDANCE(2), d ˈæ n s\n'LL, ə l\nRABBIT, ɹ ˈæ b ɪ t\nONLY, ˈəʊ n",)], "value string"))
    american = spark.createDataFrame([("dance", 0, "D AE1 N S".split()), ("dance", 1, ["X"]), ("rabbit", 0, "R AE1 B AH0 T".split())], "word string, variant int, phonemes array<string>")
    lex = lexicon.build_lexicon(american, lines)
    rows = {r.word: r for r in lex.collect()}
    assert set(rows) == {"dance", "rabbit"} and rows["dance"].rp == "D AA1 N S".split() and rows["dance"].au == "D AE1 N S".split() and rows["rabbit"].au == "R AE1 B AH0 T".split()
    texts = spark.createDataFrame([(1, "Dance, 42 rabbit!", "au"), (2, "dance zzyzx qqq", "ga"), (3, "...", "rp"), (4, None, "ga")], "id int, text string, accent string")
    got = {r.id: r for r in lexicon.text_phonemes(texts, lex).collect()}
    assert got[1].phonemes == "D AE1 N S R AE1 B AH0 T".split() and got[2].unknown_word == "zzyzx" and got[2].phonemes is None and got[3].phonemes == []
    with pytest.raises(Exception, match="unknown accent"):
        lexicon.text_phonemes(texts.withColumn("accent", F.lit("xx")), lex).collect()
    joined = {r.id: r for r in lexicon.text_phonemes(texts, lex, most_words=0).collect()}  # as with a lexicon too large to be sent
    assert all(joined[i].phonemes == got[i].phonemes and joined[i].unknown_word == got[i].unknown_word for i in got)
    assert lexicon.target_range(texts.filter("id = 1"), lex).first()[1:] == (9, 9)
    vocab = lexicon.vocabulary(spark.createDataFrame([(["K", "AE1"],)], "s array<string>"), "s")
    assert [r.ids for r in lexicon.encode(spark.createDataFrame([(["k", "zz"],)], "s array<string>"), "s", vocab).collect()] == [[1, 2]]
    assert tuple(lexicon.lexicon_statistics(lex).first()) == (2, 2, 2)


def test_evaluation(spark):
    rows = [("u1", "hi", ["K", "AE1", "T"], ["K", "IH1", "T"], [2.0, 1.0, 2.0]), ("u2", "yo", ["S"], ["S", "T"], [2.0])]
    df = spark.createDataFrame(rows, "utt_id string, text string, canonical array<string>, predicted array<string>, phone_scores array<double>")
    assert evaluation.error_rates(df, ()).first().per == 0.5
    d = evaluation.detection(evaluation.sound_flags(df)).first()
    assert (d.tp, d.fp, d.fn, d.tn, d.precision, d.recall, d.f1) == (1, 0, 0, 3, 1.0, 1.0, 1.0)
    ops = evaluation.operations(df)
    assert [tuple(r) for r in evaluation.confusions(ops).collect()] == [("AE", "IH", 1)]
    with pytest.raises(Exception, match="disagree"):
        evaluation.with_annotations(df, df.select("utt_id", "text").filter("utt_id = 'u1'")).collect()
    assert evaluation.with_annotations(df, df.select("utt_id", "text")).count() == 2
    flat = evaluation.agreement(spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert np.isnan(flat.pearson) and flat.mae == 1.0
    words = spark.createDataFrame([("a", [["K", "AE1"], ["T"]], ["G", "K", "AE1", "S", "T"]), ("b", [["K"], ["T"]], ["K"])], "utt_id string, words array<array<string>>, predicted array<string>")
    got = {(r.utt_id, r.nth): r.heard for r in evaluation.cut_words(words).collect()}
    assert got == {("a", 0): ["G", "K", "AE1", "S"], ("a", 1): ["T"], ("b", 0): ["K"], ("b", 1): []}
    s = evaluation.spread(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), "x", (2.0,)).first()
    assert s.p1 == pytest.approx(1.02) and s.median == 2.0


def test_wrong_targets(spark):
    pairs = spark.createDataFrame([(i, [c, "AE1", "T"][: 2 + i % 2], ["K"]) for i, c in enumerate("KPSTRMBD" * 4)], "id long, target array<string>, heard array<string>")
    own = {r.id: [x.rstrip("012") for x in r.target] for r in pairs.collect()}
    got = {r.id: r.target for r in evaluation.wrong_targets(pairs, slack=0.5).collect()}
    assert set(got) == set(own) and all(got[i] and got[i] != own[i] for i in got)
    few = spark.createDataFrame([(1, ["K", "AE1"], ["K"]), (2, ["K", "AE1"] * 4, ["K"])], "id long, target array<string>, heard array<string>")
    assert [r.target for r in evaluation.wrong_targets(few).collect()] == [None, None]
    for n in (2, 3, 5, 17, 18):  # any number of targets
        some = spark.createDataFrame([(i, [x, "AE1"], ["K"]) for i, x in enumerate("BDFGHKLMNPRSTVWYZ" + "JX")][:n], "id long, target array<string>, heard array<string>")
        assert all(r.target and r.target[0] != r.own for r in evaluation.wrong_targets(some).join(some.selectExpr("id", "target[0] as own"), "id").collect())


def test_frames(spark):
    logits = [[0, 9, 0], [0, 9, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9], [9, 0, 0]]
    df = spark.createDataFrame([(1, i, [float(x) for x in l]) for i, l in enumerate(logits)] + [(2, 0, [9.0, 0.0, 0.0])], "take_id int, frame int, logits array<double>")
    got = {r.take_id: r for r in frames.decode(df, {1: "K", 2: "T"}).collect()}
    assert got[1].phonemes == ["K", "K", "T"] and [tuple(s) for s in got[1].spans] == [(0.0, 0.06), (0.06, 0.08), (0.08, 0.12)] and got[1].confidence > 0.99
    assert got[2].phonemes == [] and (got[2].confidence, got[2].margin) == (0.0, 0.0)
    loud = [-70.0] * 40 + [-20.0] * 30 + [-70.0] * 60 + [-20.0] * 5 + [-70.0] * 40
    rows = [("a", i, x) for i, x in enumerate(loud)] + [("b", i, -20.0) for i in range(30)] + [("c", i, -60.0) for i in range(30)] + [("d", 0, -10.0)]
    levels = spark.createDataFrame(rows, "rec_id string, frame int, level_db double")
    lengths = levels.groupBy("rec_id").agg((F.count("*").cast("int") * 160 + 160).alias("n_samples"))
    q = {r.rec_id: r for r in frames.take_quality(levels, lengths).collect()}
    assert (q["a"].found_speech, q["a"].start, q["a"].end, q["a"].speech_seconds, q["a"].snr_db) == (True, 0, 19360, 0.31, 50.0)
    assert q["b"].found_speech and not q["c"].found_speech and not q["d"].found_speech
    tone = (0.5 * np.sin(np.arange(1600) * 0.3)).tolist()
    got = frames.frame_levels(spark.createDataFrame([("x", tone)], "rec_id string, samples array<float>")).collect()
    assert len(got) == 9 and -12 < got[5].level_db < -6


def test_cohorts(spark):
    people = spark.createDataFrame([(f"s{i}", "a") for i in range(8)], "speaker_id string, accent string")
    assert {r.speaker_id for r in cohorts.splits(people).filter("split = 'test'").collect()} == {"s3", "s7"}
    assert sorted(r.speaker_id for r in cohorts.every_fifth(people).collect()) == ["s0", "s5"]
    logs = spark.createDataFrame([("r", None, 3, 4, 0, 10, 2.0, None, 1e-5), ("r", None, 3, 4, 1, 20, 1.5552, None, 3e-5), ("r", None, 3, 4, 2, 20, None, 1.01, None), ("e", None, None, None, None, None, None, None, None)], "run string, global_step int, epochs int, batch_size int, pos int, step int, loss double, eval_loss double, learning_rate double")
    got = {r.run: r for r in cohorts.training_summary(logs).collect()}
    assert (got["r"].max_steps, got["r"].learning_rate, got["r"].final_train_loss, got["r"].best_eval_loss, got["r"].optimizer) == (20, 3e-05, 1.555, 1.01, "AdamW")
    assert got["e"].max_steps is None and got["e"].optimizer is None
    votes = spark.createDataFrame([("s", 0, "b"), ("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b")], "speaker string, seq int, prediction string")
    assert cohorts.majority_votes(votes).first().vote == "b"


def loop(x):
    """The filter sample by sample."""
    a, out, last, before = frames.decay(), [], 0.0, 0.0
    for v in x:
        last, before = a * (last + v - before), v
        out.append(last)
    return np.array(out)


def test_the_blocked_filter_equals_the_loop():
    rng = np.random.default_rng(2)
    samples = [rng.normal(size=n) for n in (0, 1, 255, 256, 257, 5000, 40_000)]
    for x, y in zip(samples, frames.high_pass(samples, np.zeros(len(samples))), strict=True):
        assert len(x) == len(y) and np.allclose(y, loop(x), rtol=0, atol=1e-9)
    whole, at = loop(samples[-1]), 12_345
    rest = frames.high_pass([samples[-1][at:]], np.array([whole[at - 1] - samples[-1][at - 1]]))[0]
    assert np.allclose(rest, whole[at:], rtol=0, atol=1e-9)


def test_pieces_have_the_frames_of_the_whole(spark):
    rng = np.random.default_rng(3)
    whole = {name: rng.normal(size=n, scale=0.1).astype(np.float32).astype(float) for name, n in (("a", 7000), ("b", 3333), ("c", 100), ("d", 321))}
    cuts = {"a": [0, 320, 1000, 1320, 4001, 6999, 7000], "b": [0, 3333], "c": [0, 100], "d": [0, 320, 321]}
    rows = [(n, k, whole[n][i:j].tolist()) for n, c in cuts.items() for k, (i, j) in enumerate(zip(c, c[1:], strict=False))]
    read = lambda df: {(r.rec_id, r.frame): r.level_db for r in df.collect()}
    at_once = read(frames.frame_levels(spark.createDataFrame([(n, x.tolist()) for n, x in whole.items()] + [("e", None), ("f", [])], "rec_id string, samples array<float>")))
    in_pieces = read(frames.frame_levels_of_pieces(spark.createDataFrame(rows, "rec_id string, piece int, samples array<float>").repartition(5)))
    assert at_once.keys() == in_pieces.keys() and len(at_once) == 42 + 19 + 1
    assert all(abs(at_once[k] - in_pieces[k]) < 1e-5 for k in at_once)
    y = loop(whole["a"]).astype(np.float32).astype(float)
    assert at_once["a", 7] == pytest.approx(10 * np.log10((y[7 * 160 : 7 * 160 + 320] ** 2).mean()), abs=1e-5)
    with pytest.raises(Exception, match="only the last piece"):
        frames.frame_levels_of_pieces(spark.createDataFrame([("a", 0, [0.1] * 10), ("a", 1, [0.1] * 400)], "rec_id string, piece int, samples array<float>")).collect()


def test_rows_are_fetched_from_their_row_groups_alone(spark, tmp_path):
    """Ten groups of ten rows, all but two of them spoilt: rows of the two can be fetched, of the others not."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "a corpus"
    folder.mkdir()
    table = pa.table({"id": list(range(100)), "text": [f"text {i}" * 50 for i in range(100)], "other": list(range(100))})
    pq.write_table(table, folder / "a.parquet", row_group_size=10, compression="none", use_dictionary=False)
    pq.write_table(table.slice(0, 5), folder / "b.parquet")
    index = cohorts.corpus_index(spark, str(folder), ("id",)).cache()
    groups = cohorts.row_groups(spark, str(folder)).cache()
    assert sorted((r.file[-9:], r.row_group, r.first, r.rows) for r in groups.collect()) == [*(("a.parquet", i, 10 * i, 10) for i in range(10)), ("b.parquet", 0, 0, 5)]
    index.count()
    raw = bytearray((folder / "a.parquet").read_bytes())
    meta = pq.ParquetFile(folder / "a.parquet").metadata
    for g in set(range(10)) - {3, 7}:
        for c in range(3):
            column = meta.row_group(g).column(c)
            raw[column.data_page_offset : column.data_page_offset + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    (folder / "a.parquet").write_bytes(raw)
    (folder / ".a.parquet.crc").unlink(missing_ok=True)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("id", T.LongType())])
    get = lambda where: [tuple(r) for r in cohorts.fetch(index.filter(where), groups, schema).collect()]
    places = "file like '%a.parquet' and id in (31, 39, 70) or file like '%b.parquet' and id = 2"
    assert sorted(get(places), key=lambda r: r[1]) == [(f"text {i}" * 50, i) for i in (2, 31, 39, 70)]
    assert get("id < 0") == []
    with pytest.raises(Exception, match="(?i)error|page|thrift"):
        get("file like '%a.parquet' and id = 5")


def test_backups_are_read_once(spark, tmp_path):
    """Rows and rejected files come from one reading, so files that change behind it change neither."""
    a = attempts(spark)
    good = {"word": "new", "timestamp": "2024-01-05 10:00:00", "score": 5, "wer": 0.1, "target_phonemes": ["K"], "predicted_phonemes": ["K"], "errors": []}
    texts = {"good": {"attempts": [good]}, "bad": {"attempts": [good, {"word": 3}]}, "none": {"attempts": None}, "empty": {"attempts": []}, "text": {"attempts": [good | {"score": "5"}]}}
    for name, body in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows, rejected = history.import_backup(spark, str(tmp_path / "*.json"), a)
    for name in texts:
        (tmp_path / f"{name}.json").write_text("{}")
    assert [(r.word, r.score, r.pos) for r in rows.collect()] == [("new", 5.0, 0)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejected.collect()) == ["bad.json", "none.json", "text.json"]
    documents = spark.createDataFrame([(n, json.dumps(b)) for n, b in texts.items()] + [("gone", None)], "path string, value string")
    rows, rejected = history.import_documents(documents, a)
    assert rows.count() == 1 and sorted(r.path for r in rejected.collect()) == ["bad", "gone", "none", "text"]
