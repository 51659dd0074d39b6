import random

from pyspark.sql import functions as F

from speechjobs.functions import gates, scoring, symbols
from speechjobs.functions.align import align_ops, any_sound_share, exact_share, same_class_share, sequence_ratio, with_alignment

ATTEMPT = "target array<string>, predicted array<string>, confidence double, margin double, native_score double"


def walk(ref, hyp):
    """A plain table of edit costs, walked back diagonal first, then deletion, then insertion."""
    cost = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, r in enumerate(ref, 1):
        for j, h in enumerate(hyp, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (r != h), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, ops = len(ref), len(hyp), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            ops.append(("equal" if ref[i] == hyp[j] else "substitute", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            ops.append(("delete", i, None))
        else:
            j -= 1
            ops.append(("insert", None, j))
    return ops[::-1]


def test_alignment_matches_plain_walk(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("ABC") for _ in range(rng.randrange(6))], [rng.choice("ABC") for _ in range(rng.randrange(6))]) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, r array<string>, h array<string>")
    for row in df.select("id", align_ops("r", "h").alias("a")).collect():
        expected = walk(*pairs[row.id])
        assert [tuple(o) for o in row.a.ops] == expected
        kinds = [o[0] for o in expected]
        assert (row.a.hits, row.a.substitutions, row.a.deletions, row.a.insertions) == tuple(kinds.count(k) for k in ("equal", "substitute", "delete", "insert"))


def test_alignment_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, ["K"], None), (2, ["K"], ["K"]), (3, ["K"], ["K"]), (4, [], [])], "id int, r array<string>, h array<string>")
    got = {r.id: r.alignment for r in with_alignment(df, "r", "h").collect()}
    assert len(got) == 4 and got[2].hits == got[3].hits == 1 and got[4].ops == []
    assert got[1] is None or got[1].ops is None


def score(spark, rows):
    df = spark.createDataFrame([(t.split(), p.split(), c, m, n) for t, p, c, m, n in rows], ATTEMPT)
    return [r.result for r in scoring.score_attempts(df).collect()]


def one(spark, *row):
    return score(spark, [row])[0]


def test_score_of_known_attempts(spark):
    assert one(spark, "K AE1 T", "K AE1 T", 0.97, 0.95, None).score == 10.0
    ship = one(spark, "SH IH1 P", "S IY1 P", 0.9, 0.9, None)
    assert [p.status for p in ship.phoneme_results] == ["error", "error", "correct"] and ship.metrics.accuracy == 33 and ship.metrics.completeness == 100
    stood = one(spark, "S T UW1 D", "S UW1 D", 0.9, 0.9, None)
    assert [(e["type"], e["index"]) for e in stood.errors] == [("delete", 1)] and stood.metrics.completeness == 75
    assert one(spark, "K", "AA B K D IY F", 0.9, 0.9, None).wer == 5.0
    assert [one(spark, "K AE1 T", "K AE1 T", 0.97, 0.95, n).score for n in (0.5, 4.2, -1.0)] == [7.0, 10.0, 4.0]
    assert one(spark, "V IH1 N", "TH AO1 T", 0.6, 0.5, 0.95).score == 3.0
    measure = one(spark, "M EH1 ZH ER0", "M EH1 JH ER0", 0.97, 0.95, None)
    assert measure.score == 10.0 and measure.phoneme_results[2].status == "unscored" and measure.errors == []
    empty = one(spark, "K AE1 T", "", 0.5, 0.5, None)
    assert (empty.score, empty.wer, [p.status for p in empty.phoneme_results]) == (0.0, 1.0, ["missed"] * 3)


def test_blend_and_certainty(spark):
    row = spark.range(1).select(scoring.combine_scores(F.lit(2.0), F.lit(9.0)), scoring.combine_scores(F.lit(8.0), F.lit(9.0)), scoring.acoustic_certainty(F.lit(0.9), F.lit(0.9)), scoring.acoustic_certainty(F.lit(0.1), F.lit(0.1))).first()
    assert [round(x, 6) for x in row] == [5.0, 8.6, 1.0, 0.0]


def test_match_measures(spark):
    rows = [("TH IH1 NG K", "T IH1 NG K", 100), ("W AO1 T ER0", "F IH1 SH", 0), ("", "K", 0), ("ZH", "K", 100)]
    df = with_alignment(spark.createDataFrame([(t.split(), h.split(), e) for t, h, e in rows], "t array<string>, h array<string>, e int"), "t", "h", "a")
    got = df.select("e", same_class_share(F.col("a.ops"), F.col("t"), F.col("h")).alias("s"), exact_share(F.col("a.ops"), F.col("t")).alias("x"), any_sound_share(F.col("a.ops"), F.col("t")).alias("n")).collect()
    assert all(r.s == r.e for r in got if r.e != 0 or r.x == 0)
    assert all(0 <= r.x <= r.n <= 100 for r in got)


def test_ipa_and_australian(spark):
    ipa = spark.createDataFrame([("w ˈɔː t ə",), ("n ˈɪə",)], "x string").select(symbols.from_ipa(F.col("x")).alias("p")).collect()
    assert [r.p for r in ipa] == [["W", "AO1", "T", "AH0"], ["N", "IH1", "AH0"]]
    rows = [("dance", "D AA1 N S", "D AE1 N S", "D AE1 N S"), ("rabbit", "R AE1 B IH0 T", "R AE1 B AH0 T", "R AE1 B AH0 T"), ("music", "M Y UW1 Z IH0 K", "M Y UW1 Z IH0 K", "M Y UW1 Z IH0 K"), ("can't", "K AA1 N T", "K AE1 N T", "K AA1 N T")]
    df = spark.createDataFrame([(w, b.split(), a.split(), e.split()) for w, b, a, e in rows], "w string, b array<string>, a array<string>, e array<string>")
    assert all(r[0] == r[1] for r in df.select(symbols.australian(F.col("b"), F.col("a"), F.col("w")), "e").collect())
    marks = spark.createDataFrame([("W AO1 T ER0", "ga"), ("K AE1 T", "ga"), ("AH0 B AW1 T", "rp"), ("HH AH0 L OW1", "rp")], "p string, a string").select(symbols.word_ipa(F.split("p", " "), F.col("a"))).collect()
    assert [m[0] for m in marks] == ["ˈwɔtɚ", "kæt", "əˈbaʊt", "həˈləʊ"]


def test_edit_distance_is_built_in(spark):
    df = spark.createDataFrame([(["AE1", "T"], ["AE0", "T"])], "r array<string>, h array<string>")
    assert tuple(df.select(symbols.edits(F.col("r"), F.col("h")), symbols.edits(F.col("r"), F.col("h"), True)).first()) == (0, 1)


def test_word_similarity(spark):
    import difflib

    df = spark.createDataFrame([("water", "waiter"), ("a", "b"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(sequence_ratio("a", "b")).collect()]
    assert got[:2] == [difflib.SequenceMatcher(None, "water", "waiter").ratio(), 0.0] and (got[2] is None or got[2] != got[2])


def test_accent_coaching(spark):
    error = F.array(F.struct(F.lit("substitute").alias("type"), F.lit(0).alias("index"), F.array(F.lit("AA1")).alias("expected"), F.array(F.lit("AE1")).alias("heard"), F.lit("t").alias("tip")))
    tips = spark.range(1).select(scoring.accent_coaching(error, F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("rp"), F.array(F.lit("AA1"))).alias("t")).first().t
    assert len(tips) == 3 and tips[0].startswith("British") and tips[1:] == ["a", "b"]


def check(spark, **changed):
    v = {"found": True, "seconds": 1.0, "snr": 40.0, "clipped": 0.0, "confidence": 0.9, "natural": False, "matched": 80.0, "heard": 4, "target": 4, "features": [0.1, 0.2]} | changed
    quality = F.struct(F.lit(v["found"]).alias("foundSpeech"), F.lit(v["seconds"]).alias("speechSeconds"), F.lit(v["snr"]).alias("snrDb"), F.lit(v["clipped"]).alias("clipped"))
    checks = gates.viability(quality, F.lit(v["confidence"]), F.lit(v["natural"]), F.lit(v["matched"]), F.lit(v["heard"]), F.lit(v["target"]), F.lit(v["target"]), F.array(*map(F.lit, v["features"])), 2)
    return spark.range(1).select(gates.decision(checks, gates.eligibility(F.lit(True), F.lit("GB"), F.lit(0))).alias("d"), checks.alias("c")).first()


def test_viability_and_decision(spark):
    assert check(spark).d.stored
    assert check(spark, heard=9).d.reason == "extra sounds, likely background noise" and check(spark, heard=9).d.retake
    assert check(spark, heard=1).d.reason == "too few sounds heard"
    assert check(spark, snr=5.0).d.reason == "did not pass: quiet background"
    assert check(spark, features=[float("nan"), 1.0]).d.reason == "did not pass: summary is well formed"
    assert len(check(spark, natural=True, matched=0.0, heard=8).c) == 6 and check(spark, natural=True, matched=0.0, heard=8).d.stored


def test_gates(spark):
    r = spark.range(1).select(
        gates.heard_no_speech(F.lit(1), F.lit(2.0)), gates.heard_no_speech(F.lit(5), F.lit(6.0)), gates.heard_no_speech(F.lit(5), F.lit(0.0)), gates.retake_reason(F.lit(True), F.lit(5.0), F.lit(1.0)),
        gates.profile(F.lit("GB"), F.lit("NE"), F.lit(True), ["GB"]), gates.home_accent(F.lit("GB"), F.lit("rp"), F.lit(False)), gates.home_accent(F.lit("IN"), F.lit("ga"), F.lit(False)),
    ).first()
    assert tuple(r)[:4] == (True, True, False, "noisy") and tuple(r[4]) == ("GB", None, True) and (r[5], r[6]) == (True, False)
