"""Scores, feedback and coaching of one practice attempt, from an alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.align import align_ops, once_per_pair, sequence_ratio
from speechjobs.functions.symbols import among, clarity_tips, edits, stress_of, strip_all, strip_stress, tip

#: (low, high) of confidence and of margin.
RANGES = {True: ((0.60, 0.90), (0.50, 0.90)), False: ((0.82, 0.96), (0.55, 0.80))}


def within(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def acoustic_certainty(confidence: Column, margin: Column, phoneme_model: bool = True) -> Column:
    c, m = RANGES[phoneme_model]
    return 0.7 * within(confidence, *c) + 0.3 * within(margin, *m)


def combine_scores(alignment: Column, learned: Column) -> Column:
    """Blend with a learned rating, at most three points above the alignment's score, within 0 to 10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), 0.6 * learned + 0.4 * alignment, alignment + 3.0))


def _pair_facts(pairs: DataFrame, phoneme_model: bool) -> DataFrame:
    """Adds ``__f``: all of a score that follows from the target (``ref``) and the heard sounds (``hyp``) alone."""
    target, predicted = F.col("ref"), F.col("hyp")
    df = pairs.withColumn("__a", align_ops(strip_all(target), strip_all(predicted)))
    ops = F.col("__a.ops")
    sound = lambda i: strip_stress(F.get(target, i))
    skipped = lambda o: (o["kind"].isin("substitute", "delete") & among(sound(o["ref_index"]), K.UNSCORABLE)) if phoneme_model else F.lit(False)
    count = lambda test: F.size(F.filter(ops, test))
    total = F.greatest(F.size(target), F.lit(1))
    free = count(skipped)
    subs = count(lambda o: (o["kind"] == "substitute") & ~skipped(o))
    dels = count(lambda o: (o["kind"] == "delete") & ~skipped(o))
    agrees = lambda o: F.coalesce(stress_of(F.get(target, o["ref_index"])) == stress_of(F.get(predicted, o["hyp_index"])), F.lit(False))
    stressed = F.filter(ops, lambda o: (o["kind"] == "equal") & stress_of(F.get(target, o["ref_index"])).isNotNull())
    stress = F.struct(F.size(F.filter(stressed, agrees)).alias("matched"), F.size(stressed).alias("total"))
    # operations with a target sound stand in its order: one for each sound
    placed = F.filter(ops, lambda o: o["ref_index"].isNotNull())

    def result(o: Column) -> Column:
        p = F.get(target, o["ref_index"])
        heard = F.when(o["hyp_index"].isNotNull(), F.get(predicted, o["hyp_index"]))
        status = F.when(skipped(o), "unscored").when(o["kind"] == "equal", "correct").when(o["kind"] == "substitute", "error").otherwise("missed")
        words = F.when(status == "unscored", F.lit(K.UNSCORABLE_TIP)).when(status == "correct", "").when(status == "error", F.concat(F.lit("Heard "), strip_stress(heard), F.lit(" instead."))).otherwise(tip(p))
        fits = F.when((o["kind"] == "equal") & stress_of(p).isNotNull(), agrees(o))
        nowhere = F.lit(None).cast("double")
        return F.struct(p.alias("phoneme"), status.alias("status"), heard.alias("heard"), words.alias("tip"), nowhere.alias("start"), nowhere.alias("end"), fits.alias("stress_match"), o["hyp_index"].alias("hyp_index"))

    wrong = F.filter(ops, lambda o: o["kind"].isin("substitute", "delete") & ~skipped(o))
    none = F.array().cast("array<string>")
    errors = F.transform(wrong, lambda o: F.struct(
        o["kind"].alias("type"), o["ref_index"].alias("index"), F.array(F.get(target, o["ref_index"])).alias("expected"),
        F.when(o["kind"] == "substitute", F.array(F.get(predicted, o["hyp_index"]))).otherwise(none).alias("heard"), tip(F.get(target, o["ref_index"])).alias("tip")))
    facts = F.struct(
        total.alias("total"), (F.col("__a.hits") + free).alias("hits"), subs.alias("subs"), F.col("__a.insertions").alias("ins"), ((subs + dels + F.col("__a.insertions")) / total).alias("per"),
        (edits(target, predicted, stress=True) / total).alias("pers"), stress.alias("stress"), F.transform(placed, result).alias("sounds"), errors.alias("errors"),
        F.slice(F.array_distinct(F.transform(errors, lambda e: e["tip"])), 1, 3).alias("tips"), clarity_tips(target).alias("clarity"),
    )
    return df.withColumn("__f", facts)


def score_attempts(attempts: DataFrame, phoneme_model: bool = True) -> DataFrame:
    """Score attempts (target, predicted, confidence, margin; optional native_score, spans, word, recognized_text).

    Adds ``result``: score, wer, per_with_stress, metrics, stress, phoneme_results, errors, feedback, coaching_tips, and
    unrounded ``per``. Nothing heard gives the empty attempt. What follows from the sounds alone is worked out once for
    each distinct pair of target and heard sounds; rows only weigh in how sure the recogniser was.
    """
    have = set(attempts.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    df = once_per_pair(attempts, "target", "predicted", lambda pairs: _pair_facts(pairs, phoneme_model), "__f")
    target = F.col("target")
    accuracy = F.greatest(F.lit(0.0), 1 - F.col("__f.per"))
    certainty = acoustic_certainty(F.col("confidence"), F.col("margin"), phoneme_model)
    heard_text, word = col("recognized_text", "string"), col("word", "string")
    close = F.coalesce(F.lower(heard_text) == F.lower(word), F.lit(False)) & F.lit(not phoneme_model)
    if phoneme_model:
        base = 10 * (0.9 * accuracy + 0.1 * certainty)
        native = col("native_score", "double")
        score = F.when(native.isNotNull(), combine_scores(base, F.greatest(F.lit(0.0), F.least(F.lit(1.0), native)) * 10)).otherwise(base)
    else:
        match = F.when((word != "") & heard_text.isNotNull(), sequence_ratio(F.lower(heard_text), F.lower(word))).otherwise(accuracy)
        base = 10 * (0.55 * accuracy + 0.15 * match + 0.30 * certainty)
        score = F.when(close & (certainty < 0.92), F.least(base, F.lit(8.4))).otherwise(base)
    df = df.withColumn("__score", F.bround(score, 1))
    total, hits = F.col("__f.total"), F.col("__f.hits")
    tolerated = F.greatest(F.lit(2), F.floor(total / 2))
    whole = lambda x: F.bround(x, 0).cast("int")
    metrics = F.struct(
        whole(hits / total * 100).alias("accuracy"), whole((hits + F.col("__f.subs")) / total * 100).alias("completeness"),
        whole((0.55 * F.greatest(F.lit(0.0), 1 - F.col("__f.ins") / tolerated) + 0.45 * certainty) * 100).alias("fluency"),
    )
    spans = col("spans", "array<struct<start:double,end:double>>")

    def with_span(r: Column) -> Column:
        span = F.when(r["hyp_index"].isNotNull(), F.get(spans, r["hyp_index"]))
        return F.struct(*[r[c].alias(c) for c in ("phoneme", "status", "heard", "tip")], span["start"].alias("start"), span["end"].alias("end"), r["stress_match"].alias("stress_match"))

    errors = F.col("__f.errors")
    faultless = F.size(errors) == 0
    none = F.array().cast("array<string>")
    feedback = F.when(faultless & (F.col("__score") >= 8.5), K.FEEDBACK["great"]).when(close, F.concat(F.lit(K.FEEDBACK["close"][0]), heard_text, F.lit(K.FEEDBACK["close"][1]))).when(faultless, K.FEEDBACK["clear"]).otherwise(K.FEEDBACK["focus"])
    tips = F.when(faultless & (F.col("__score") >= 8.5), none).when(close | faultless, F.col("__f.clarity")).otherwise(F.col("__f.tips"))
    full = F.struct(
        F.col("__score").alias("score"), F.bround("__f.per", 2).alias("wer"), F.bround("__f.pers", 2).alias("per_with_stress"), metrics.alias("metrics"), F.col("__f.stress").alias("stress"),
        F.transform("__f.sounds", with_span).alias("phoneme_results"), errors.alias("errors"), feedback.alias("feedback"), tips.alias("coaching_tips"), F.col("__f.per").alias("per"),
    )
    zero, nothing = F.lit(0), F.lit(None).cast("string")
    missed = F.transform(target, lambda p: F.struct(p.alias("phoneme"), F.lit("missed").alias("status"), nothing.alias("heard"), tip(p).alias("tip"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("boolean").alias("stress_match")))
    empty = F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("wer"), F.lit(1.0).alias("per_with_stress"), F.struct(zero.alias("accuracy"), zero.alias("completeness"), zero.alias("fluency")).alias("metrics"), F.struct(zero.alias("matched"), zero.alias("total")).alias("stress"), missed.alias("phoneme_results"), F.array().cast("array<struct<type:string,index:int,expected:array<string>,heard:array<string>,tip:string>>").alias("errors"), F.lit(K.FEEDBACK["empty"]).alias("feedback"), none.alias("coaching_tips"), F.lit(1.0).alias("per"))
    return df.withColumn("result", F.when(F.size("predicted") > 0, full).otherwise(empty)).select(*attempts.columns, "result")


def accent_tip(error: Column, accent: Column, target: Column) -> Column:
    """A tip for using another accent's form, or null."""
    expected, heard = strip_stress(F.get(error["expected"], F.lit(0))), strip_stress(F.get(error["heard"], F.lit(0)))
    name = F.coalesce(*[F.when(accent == a, n) for a, n in K.ACCENT_NAMES.items()], F.lit("this accent"))
    soft = among(accent, K.NON_RHOTIC)
    said = lambda text: F.concat(name, F.lit(text))
    after = strip_stress(F.get(target, error["index"] + 1))
    return (
        F.when(soft & (expected == "AH") & (heard == "ER"), said(' English has no r here. Let the ending relax into a plain "uh".'))
        .when(~soft & (expected == "ER") & ((heard == "AH") | heard.isNull()), said(" English keeps the r. Curl your tongue back as the vowel finishes."))
        .when(~soft & (expected == "R") & heard.isNull(), said(" English pronounces this r. Do not let it disappear after the vowel."))
        .when(soft & (expected == "AA") & (heard == "AE"), said(' English uses the long "ah" of "father" in this word, not the short "a" of "cat".'))
        .when((expected == "AE") & (heard == "AA"), said(' English uses the short "a" of "cat" in this word, not the long "ah" of "father".'))
        .when((expected == "Y") & heard.isNull() & (after == "UW"), said(' English slips a "y" in before this vowel: "nyoo", not "noo".'))
    )


def accent_coaching(errors: Column, tips: Column, accent: Column, target: Column) -> Column:
    """Accent tips before the generic ones, three in all."""
    own = F.array_distinct(F.array_compact(F.transform(errors, lambda e: accent_tip(e, accent, target))))
    return F.when(F.size(own) > 0, F.slice(F.concat(own, tips), 1, 3)).otherwise(tips)
