"""Rules that decide about one take: viability, eligibility, recording, silence, labels, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.symbols import half_up, table


def home_accent(country: Column, target: Column, natural: Column) -> Column:
    """Whether a practice take aims at the standard accent of its country."""
    return ~natural & F.coalesce(table(K.HOME_ACCENT)[country] == target, F.lit(False))


def route(country: Column, region: Column, target: Column, natural: Column) -> Column:
    """struct(kind, keys): what totals a take joins."""
    native = F.array_compact(F.array(country, F.when(region.isNotNull() & (region != ""), F.concat_ws("-", country, region))))
    return F.when(natural, F.struct(F.lit("native").alias("kind"), native.alias("keys"))).otherwise(F.struct(F.lit("attempt").alias("kind"), F.array(F.concat(country, F.lit(">"), target)).alias("keys")))


def allowed_sounds(fewest: Column, most: Column, natural: Column) -> Column:
    """struct(fewest, most) sounds that a take of a target may have."""
    factor = F.when(natural, K.VIABILITY["longest_voice"]).otherwise(K.VIABILITY["longest_practice"])
    return F.struct(F.ceil(fewest * K.VIABILITY["shortest"]).cast("int").alias("fewest"), F.floor(most * factor).cast("int").alias("most"))


def heard_no_speech(sounds: Column, speech_seconds: Column) -> Column:
    """Fewer than two sounds, or under one sound a second."""
    return (sounds < 2) | ((speech_seconds > 0) & F.coalesce(F.try_divide(sounds, speech_seconds) < 1, F.lit(False)))


def retake_reason(found_speech: Column, snr_db: Column, seconds: Column) -> Column:
    """Why a recording is not scored, or null."""
    return F.when(~found_speech, "silent").when(snr_db < 10, "noisy").when(seconds < 0.3, "short")


def finite(features: Column) -> Column:
    return F.coalesce(F.forall(features, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def viability(quality: Column, confidence: Column, natural: Column, matched: Column, heard: Column, fewest: Column, most: Column, features: Column, feature_count: int = K.FEATURES) -> Column:
    """Ordered checks of a take: array of struct(id, label, passed, detail, reason); reason only where one failed.

    ``quality``: struct(foundSpeech, speechSeconds, snrDb, clipped).
    """
    v = K.VIABILITY
    allowed = allowed_sounds(fewest, most, natural)
    number = lambda x, d: F.format_string(f"%.{d}f", x.cast("double"))
    good = (F.size(features) == feature_count) & finite(features)
    rows = [
        ("speech", F.lit("Speech found"), quality["foundSpeech"] & (quality["speechSeconds"] >= v["speech_seconds"]), F.concat(number(quality["speechSeconds"], 2), F.lit(" s of speech (needs 0.25 s)")), None),
        ("snr", F.lit("Quiet background"), quality["snrDb"] >= v["snr_db"], F.concat(number(quality["snrDb"], 1), F.lit(" dB above the background (needs 20 dB)")), None),
        ("clipping", F.lit("Not clipped"), quality["clipped"] <= v["clipped"], F.concat(number(quality["clipped"] * 100, 2), F.lit("% of samples at full scale (limit 0.5%)")), None),
        ("confidence", F.lit("Model was confident"), confidence >= v["confidence"], F.concat(F.lit("confidence "), number(confidence, 2), F.lit(" (needs 0.5)")), None),
        ("length", F.when(natural, "About as long as the sentence").otherwise("About as long as the word"), heard.between(allowed["fewest"], allowed["most"]), F.concat(heard.cast("string"), F.lit(" sounds heard (needs "), allowed["fewest"].cast("string"), F.lit(" to "), allowed["most"].cast("string"), F.lit(")")), F.when(heard > allowed["most"], K.EXTRA_SOUNDS).otherwise(K.TOO_FEW_SOUNDS)),
        ("matched", F.lit("Recognisably the target word"), matched >= v["matched"], F.concat(F.floor(matched + 0.5).cast("string"), F.lit("% of target sounds heard as written (needs 30%)")), None),
        ("features", F.lit("Summary is well formed"), good, F.when(F.coalesce(good, F.lit(False)), f"{feature_count} finite numbers").otherwise("the model did not return a usable summary"), None),
    ]
    made = []
    for name, label, passed, detail, reason in rows:
        ok = F.coalesce(passed, F.lit(False))
        why = F.lit(None).cast("string") if reason is None else F.when(~ok, reason)
        check = F.struct(F.lit(name).alias("id"), label.alias("label"), ok.alias("passed"), detail.alias("detail"), why.alias("reason"))
        made.append(F.when(~natural, check) if name == "matched" else check)
    return F.array_compact(F.array(*made))


def viable(checks: Column) -> Column:
    return F.forall(checks, lambda c: c["passed"])


def eligibility(contribute: Column, country: Column, stored: Column) -> Column:
    """Why a device keeps no takes, or null."""
    full = f"this device already holds {K.MAX_STORED} takes, the most it keeps"
    return F.when(~F.coalesce(contribute, F.lit(False)), '"Help it learn" is off').when(F.coalesce(country, F.lit("")) == "", "no country in your profile, so the take cannot be placed in a region").when(stored >= K.MAX_STORED, full)


def decision(checks: Column, ineligible: Column) -> Column:
    """struct(stored, reason, retake): eligibility first, then a check's own reason, else the names of what failed."""
    failing = F.filter(checks, lambda c: ~c["passed"])
    own = F.get(F.filter(failing, lambda c: c["reason"].isNotNull()), F.lit(0))["reason"]
    named = F.concat(F.lit("did not pass: "), F.array_join(F.transform(failing, lambda c: F.lower(c["label"])), ", "))
    reason = F.coalesce(ineligible, F.when(F.size(failing) > 0, F.coalesce(own, named)))
    retake = F.exists(failing, lambda c: F.coalesce(c["reason"] == K.EXTRA_SOUNDS, F.lit(False)))
    return F.struct(reason.isNull().alias("stored"), reason.alias("reason"), retake.alias("retake"))


def contribution(take: dict[str, Column]) -> Column:
    """The stored record of a take. ``take``: id, created, contributor, country, region, target_accent, natural_voice,
    word, score, features, speech_seconds, snr_db, clipped, confidence, sounds_heard, sounds_matched,
    sounds_same_class, model_version."""
    natural = take["natural_voice"]
    practice = lambda x: F.when(~natural, x)
    quality = F.struct(
        take["speech_seconds"].alias("speech_seconds"), take["snr_db"].alias("snr_db"), half_up(take["clipped"], 6).alias("clipped"), half_up(take["confidence"], 3).alias("confidence"),
        take["sounds_heard"].alias("sounds_heard"), practice(F.floor(take["sounds_matched"] + 0.5)).alias("sounds_matched"), practice(F.floor(take["sounds_same_class"] + 0.5)).alias("sounds_same_class"),
    )
    plain = [take[c].alias(c) for c in ("id", "created", "contributor", "country", "region")]
    return F.struct(
        *plain, practice(take["target_accent"]).alias("target_accent"), natural.alias("natural_voice"), home_accent(take["country"], take["target_accent"], natural).alias("matches_home_accent"),
        take["word"].alias("word"), practice(take["score"]).alias("score"), F.transform(take["features"], lambda x: half_up(x, 4)).alias("features"), quality.alias("quality"), take["model_version"].alias("model_version"),
    )


def profile(country: Column, region: Column, contribute: Column, countries: list[str]) -> Column:
    """A profile with only known values: unknown country or a region of another country become null."""
    place = F.when(country.isin(countries), country)
    known = F.when(F.coalesce(F.array_contains(table(K.REGIONS)[place], region), F.lit(False)), region)
    return F.struct(place.alias("country"), known.alias("region"), F.coalesce(contribute, F.lit(False)).alias("contribute"))
