"""Registered queries of the rules about single attempts, takes and words, with their SQL. Views are those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions import gates
from speechjobs.functions.scoring import acoustic_certainty, combine_scores, score_attempts
from speechjobs.functions.symbols import australian
from speechjobs.operators import cohorts, evaluation, history
from speechjobs.operators.frames import frame_levels_of_pieces
from speechjobs.operators.lexicon import encode, practice_words, target_range, text_problem, vocabulary
from speechjobs.plans import views
from speechjobs.plans.queries import _ATTEMPTS, _HEARD, _LEXICON, ORACLE, query
from speechjobs.sources.shared import new_folder


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in values.items()) + "}"


def _within(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, ({x} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)))"


_VOWEL = "regexp_matches({}, '[012]$')"
#: A row for each target sound: what became of it. i counts from 1.
_SOUNDS = f"""
sounds AS (
  SELECT id, word, accent, n, i, t[i] AS p, s[i] AS bare,
         CASE WHEN n = 1 AND i = 1 THEN 'missed' WHEN n = 2 AND {_VOWEL.format("t[i]")} AND s[i] <> 'AH' THEN 'error' WHEN n = 4 AND t[i] = 'R' THEN 'error' ELSE 'correct' END AS status
  FROM attempts, unnest(generate_series(1, len(t))) AS u(i))"""
_TIP = f"coalesce({_map(K.TIPS)}[bare], {_text(K.DEFAULT_TIP[0])} || p || {_text(K.DEFAULT_TIP[1])})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir)
    sure = ((F.col("id") % 10) / 10).alias("confidence"), ((F.col("id") % 7) / 8).alias("margin")
    return score_attempts(a.select("id", F.col("target_phonemes").alias("target"), F.col("predicted_phonemes").alias("predicted"), *sure))


@query(
    f"""SELECT id, round_even(10 * (0.9::DOUBLE * greatest(0.0, 1 - per) + 0.1::DOUBLE * sure), 1) AS score, round_even(pers, 2) AS per_with_stress,
       round_even((len(t) - (n = 1)::INT) / len(t) * 100, 0)::INT AS completeness, round_even((0.55::DOUBLE * (1 - (n = 3)::INT / greatest(2, len(t) // 2)) + 0.45::DOUBLE * sure) * 100, 0)::INT AS fluency,
       len(list_filter(t, lambda p, i: {_VOWEL.format("p")} AND NOT (n = 1 AND i = 1) AND (n <> 2 OR p = 'AH0')))::INT AS stress_matched,
       len(list_filter(t, lambda p, i: {_VOWEL.format("p")} AND NOT (n = 1 AND i = 1) AND (n <> 2 OR s[i] = 'AH')))::INT AS stress_total
       FROM (SELECT *, (len(e) + (n = 3)::INT) / len(t) AS per, CASE WHEN n = 2 THEN len(list_filter(t, lambda p: {_VOWEL.format("p")} AND p <> 'AH0')) ELSE len(e) + (n = 3)::INT END / len(t) AS pers,
             0.7::DOUBLE * {_within("((id % 10) / 10)", 0.60, 0.90)} + 0.3::DOUBLE * {_within("((id % 7) / 8)", 0.50, 0.90)} AS sure FROM wrong)""",
    _ATTEMPTS,
)
def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, sf_dir)
    metrics = F.col("result.metrics.completeness").alias("completeness"), F.col("result.metrics.fluency").alias("fluency")
    return r.select("id", "result.score", "result.per_with_stress", *metrics, F.col("result.stress.matched").alias("stress_matched"), F.col("result.stress.total").alias("stress_total"))


@query(
    f"""SELECT id, status, p AS phoneme, (i - 1)::INT AS place,
       CASE status WHEN 'missed' THEN NULL WHEN 'error' THEN CASE n WHEN 2 THEN 'AH0' ELSE 'L' END ELSE CASE WHEN n = 2 AND {_VOWEL.format("p")} THEN 'AH0' ELSE p END END AS heard,
       CASE status WHEN 'missed' THEN {_TIP} WHEN 'error' THEN 'Heard ' || CASE n WHEN 2 THEN 'AH' ELSE 'L' END || ' instead.' ELSE '' END AS tip,
       CASE WHEN status = 'correct' AND {_VOWEL.format("p")} THEN n <> 2 OR p = 'AH0' END AS stress_match FROM sounds""",
    _ATTEMPTS,
    _SOUNDS,
)
def sound_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("id", F.posexplode("result.phoneme_results").alias("place", "r"))
    return rows.select("id", "place", *(f"r.{c}" for c in ("phoneme", "status", "heard", "tip", "stress_match")))


@query(
    f"""SELECT id, faultless, CASE WHEN faultless AND score >= 8.5 THEN {_text(K.FEEDBACK["great"])} WHEN faultless THEN {_text(K.FEEDBACK["clear"])} ELSE {_text(K.FEEDBACK["focus"])} END AS feedback,
       array_to_string(CASE WHEN faultless AND score >= 8.5 THEN [] WHEN faultless AND len(clear) > 0 THEN clear[:3] WHEN faultless THEN [{_text(K.DEFAULT_CLARITY)}] ELSE tips[:3] END, '|') AS coaching
       FROM (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS clear, list_filter(w, lambda x, i: list_position(w, x) = i) AS tips FROM (
       SELECT id, len(e) = 0 AS faultless, round_even(10 * (0.9::DOUBLE * greatest(0.0, 1 - (len(e) + (n = 3)::INT) / len(t)) + 0.1::DOUBLE * (0.7::DOUBLE * {_within("((id % 10) / 10)", 0.60, 0.90)} + 0.3::DOUBLE * {_within("((id % 7) / 8)", 0.50, 0.90)})), 1) AS score,
              list_filter(list_transform(s, lambda x: {_map(K.CLARITY)}[x]), lambda x: x IS NOT NULL) AS c, list_transform(e, lambda x: {_map(K.TIPS)}[x]) AS w FROM wrong))""",
    _ATTEMPTS,
)
def feedback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, sf_dir)
    return r.select("id", (F.size("result.errors") == 0).alias("faultless"), "result.feedback", F.array_join("result.coaching_tips", "|").alias("coaching"))


@query(
    f"""SELECT event_id, round(phoneme, 9) AS phoneme_model, round(0.7::DOUBLE * {_within("value / 40", 0.82, 0.96)} + 0.3::DOUBLE * {_within("(event_id % 100) / 100", 0.55, 0.80)}, 9) AS word_model,
       round(greatest(0.0, least(10.0, 0.6::DOUBLE * (event_id % 11) + 0.4::DOUBLE * (phoneme * 10), phoneme * 10 + 3)), 9) AS blended
       FROM (SELECT *, 0.7::DOUBLE * {_within("value / 40", 0.60, 0.90)} + 0.3::DOUBLE * {_within("(event_id % 100) / 100", 0.50, 0.90)} AS phoneme FROM events)"""
)
def certainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence, margin = F.col("value") / 40, (F.col("event_id") % 100) / 100
    phoneme = acoustic_certainty(confidence, margin)
    made = {"phoneme_model": phoneme, "word_model": acoustic_certainty(confidence, margin, False), "blended": combine_scores(phoneme * 10, (F.col("event_id") % 11).cast("double"))}
    return views.read(spark, sf_dir, "events").select("event_id", *(F.round(c, 9).alias(name) for name, c in made.items()))


_ALIKE = any({"R", "L"} <= set(g) for g in K.CONSONANT_GROUPS)
#: Percent of the target by each rule; every stand-in of the view but R as L is a vowel for a vowel.
_MEASURES = f"""
measures AS (
  SELECT id, n, t, unnest(['exact', 'same_class', 'any_sound']) AS rule,
         unnest([100.0 * (len(t) - len(e)) / len(t), round_even(100.0 * (len(t) - (n = 1)::INT - {0 if _ALIKE else "CASE n WHEN 4 THEN len(e) ELSE 0 END"}) / len(t), 0), 100.0 * (len(t) - (n = 1)::INT) / len(t)]) AS share FROM wrong)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.attempts(spark, sf_dir).withColumn("variant", F.col("id") % 5)
    return evaluation.match_measures(pairs, "target_phonemes", "predicted_phonemes")


@query(
    """SELECT measures.n::BIGINT AS variant, rule, threshold::INT AS threshold, count(*) AS n, round(avg((share >= threshold)::INT), 9) AS kept
       FROM measures, unnest([30, 40, 50, 60, 70, 80]) AS u(threshold) GROUP BY measures.n, rule, threshold""",
    _ATTEMPTS,
    _MEASURES,
)
def all_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pass_rates(_measured(spark, sf_dir), ("variant",)).withColumn("kept", F.round("kept", 9))


@query("SELECT measures.n::BIGINT AS variant, len(t)::INT AS length, count(*) AS n, round(avg((share >= 70)::INT), 9) AS kept FROM measures WHERE rule = 'same_class' AND len(t) IN (3, 4, 5) GROUP BY measures.n, len(t)", _ATTEMPTS, _MEASURES)
def pass_rates_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kept_by_length(_measured(spark, sf_dir), "variant", "same_class", 70, "target_phonemes").withColumn("kept", F.round("kept", 9))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'silent' WHEN value < 10 THEN 'noisy' WHEN event_id % 8 / 10 < 0.3::DOUBLE THEN 'short' END AS retake FROM events")
def retakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = gates.retake_reason(F.col("event_type") != "error", F.col("value"), F.col("event_id") % 8 / 10)
    return views.read(spark, sf_dir, "events").select("event_id", why.alias("retake"))


@query(
    """SELECT vec_id, country, CASE WHEN NOT own THEN target END AS target_accent, NOT own AND coalesce(CASE country WHEN 'US' THEN 'ga' WHEN 'GB' THEN 'rp' WHEN 'AU' THEN 'au' END = target, false) AS matches_home_accent,
       CASE WHEN NOT own THEN label / 10 END AS score, round(list_sum(list_transform(x, lambda y: floor(y * 10000 + 0.5) / 10000)), 4) AS total, floor(x[1] * 1000000 + 0.5) / 1000000 AS clipped, floor(x[2] * 1000 + 0.5) / 1000 AS confidence,
       CASE WHEN NOT own THEN floor(label + 0.5)::BIGINT END AS sounds_matched
       FROM (SELECT vec_id, label, vec_id % 3 = 0 AS own, ['US','GB','AU','FR'][label % 4 + 1] AS country, ['ga','rp','au'][vec_id % 3 + 1] AS target, embedding::DOUBLE[] AS x FROM embeddings)"""
)
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    v, label, x = F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>")
    none = F.lit(None).cast("string")
    take = {
        "id": v, "created": v, "contributor": v, "country": pick(("US", "GB", "AU", "FR"), label), "region": none, "target_accent": pick(K.ACCENTS, v), "natural_voice": v % 3 == 0, "word": none, "score": label / 10, "features": x,
        "speech_seconds": F.lit(1.0), "snr_db": F.lit(30.0), "clipped": x[0], "confidence": x[1], "sounds_heard": label, "sounds_matched": label.cast("double"), "sounds_same_class": label.cast("double"), "model_version": none,
    }
    r = views.read(spark, sf_dir, "embeddings").select("vec_id", gates.contribution(take).alias("r"))
    total = F.round(F.aggregate("r.features", F.lit(0.0), lambda s, y: s + y), 4).alias("total")
    return r.select("vec_id", "r.country", "r.target_accent", "r.matches_home_accent", "r.score", total, "r.quality.clipped", "r.quality.confidence", "r.quality.sounds_matched")


_KNOWN = " OR ".join(f"(country = {_text(c)} AND region IN ({', '.join(map(_text, rs))}))" for c, rs in K.REGIONS.items())


@query(
    f"""SELECT event_id, CASE WHEN country <> 'XX' THEN country END AS country, CASE WHEN {_KNOWN} THEN region END AS region, coalesce(contribute, false) AS contribute FROM (
       SELECT event_id, ['US','GB','AU','XX'][user_id % 4 + 1] AS country, ['NE','SCT','E','ZZ',NULL][event_id % 5 + 1] AS region, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS contribute FROM events)"""
)
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    contribute = F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 0)
    p = gates.profile(pick(("US", "GB", "AU", "XX"), F.col("user_id")), pick(("NE", "SCT", "E", "ZZ", None), F.col("event_id")), contribute, list(K.REGIONS))
    return views.read(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.country", "p.region", F.col("p.contribute").alias("contribute"))


@query("SELECT count(*) AS utterances, count(DISTINCT user_id) AS speakers, sum(len(t))::BIGINT AS phones, round(sum(value) / 60, 6) AS minutes FROM attempts", _ATTEMPTS)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).select(F.col("user_id").alias("speaker"), F.col("target_phonemes").alias("canonical"), F.col("value").alias("seconds"))
    return evaluation.corpus_summary(a).withColumn("minutes", F.round("minutes", 6))


@query(
    """SELECT word AS condition, count(*) AS takes, count(*) FILTER (value <= 0) AS without_speech, round(avg((k < 2 OR (value > 0 AND k / (value / 10) < 1))::INT), 9) AS silent,
       round(quantile_cont(k / (value / 10), 0.01) FILTER (value > 0), 9) AS rate_p1, round(quantile_cont(k / (value / 10), 0.5) FILTER (value > 0), 9) AS rate_median,
       round(avg((k < ceil(0.5 * len(t)))::INT), 9) AS too_few, round(avg((k > floor(1.5 * len(t)))::INT), 9) AS extra, round(avg((k < ceil(0.5 * len(t)) OR k > floor(1.5 * len(t)))::INT), 9) AS dropped,
       round(avg((value / 40 < 0.5)::INT), 9) AS unsure, round(avg((value < 20)::INT), 9) AS noisy, round(avg((id % 100 < 30)::INT), 9) AS unmatched FROM (SELECT *, id % 9 AS k FROM attempts) GROUP BY word""",
    _ATTEMPTS,
)
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("target_phonemes")
    rows = views.attempts(spark, sf_dir).select(F.col("word").alias("condition"), (F.col("id") % 9).alias("sounds"), (F.col("value") / 10).alias("speech_seconds"), n.alias("fewest"), n.alias("most"), (F.col("value") / 40).alias("confidence"), F.col("value").alias("snr_db"), (F.col("id") % 100).alias("matched"))
    s = evaluation.condition_summary(rows)
    return s.withColumns({c: F.round(c, 9) for c in s.columns if c not in ("condition", "takes", "without_speech")})


@query(
    """SELECT 'ga high real' AS scope, id FROM attempts WHERE accent = 'ga' AND score >= 8 AND source = 'real' UNION ALL SELECT 'low', id FROM attempts WHERE score < 5
       UNION ALL SELECT 'kept', id FROM attempts WHERE source <> 'sample' UNION ALL (SELECT 'newest', id FROM attempts ORDER BY id DESC LIMIT 30)""",
    _ATTEMPTS,
)
def history_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).withColumn("accent", F.when(F.col("accent") != "ga", F.col("accent")))
    parts = {"ga high real": history.scope(a, "ga", "high", "real"), "low": history.scope(a, band="low"), "kept": history.cleared(a, "sample"), "newest": history.newest(a, 30)}
    rows = [part.select(F.lit(name).alias("scope"), "id") for name, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    f"""SELECT id, (i - 1)::INT AS place, p AS phoneme, status, CASE WHEN status = 'error' THEN CASE n WHEN 2 THEN 'AH0' ELSE 'L' END END AS heard, CASE WHEN status <> 'correct' THEN {_TIP} END AS tip FROM sounds""", _ATTEMPTS, _SOUNDS
)
def attempt_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.marks(views.attempts_with_errors(spark, sf_dir)).select("id", F.posexplode("marks").alias("place", "m"))
    return rows.select("id", "place", "m.phoneme", "m.status", "m.heard", "m.tip")


@query(
    r"""SELECT id, CASE WHEN n < 1 THEN 'empty' WHEN n > 8 THEN 'too many words' WHEN length(text) > 60 THEN 'too long' END AS problem FROM (
       SELECT id, text, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z'' ]+', ' ', 'g'), ' +'), lambda w: w <> '')) AS n FROM (
       SELECT 'page ' || page_id AS id, url AS text FROM pages
       UNION ALL SELECT 'event ' || event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN repeat(event_type, 20) ELSE repeat(event_type || ' ', 12) END FROM events))"""
)
def text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole addresses of pages, and names, numbers and repeated names of events."""
    pages = views.read(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("id"), F.col("url").alias("text"))
    n, name = F.col("event_id") % 4, F.col("event_type")
    made = F.when(n == 0, name).when(n == 1, F.col("event_id").cast("string")).when(n == 2, F.repeat(name, F.lit(20))).otherwise(F.repeat(F.concat(name, F.lit(" ")), F.lit(12)))
    events = views.read(spark, sf_dir, "events").select(F.concat(F.lit("event "), "event_id").alias("id"), made.alias("text"))
    return pages.unionByName(events).select("id", text_problem(F.col("text")).alias("problem"))


@query(
    """SELECT id AS utt_id, nth::INT AS nth, array_to_string(phones, ' ') AS target FROM (
       SELECT id, unnest([0, 1]) AS nth, unnest([t[1:3], t]) AS phones, unnest([value / 10, score]) AS rated FROM attempts WHERE score <= 8) WHERE rated <= 5 AND len(phones) IN (3, 4, 5)""",
    _ATTEMPTS,
)
def low_rated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("target_phonemes")
    words = F.array(F.struct(F.slice(t, 1, 3).alias("phones"), (F.col("value") / 10).alias("accuracy")), F.struct(t.alias("phones"), F.col("score").alias("accuracy")))
    a = views.attempts(spark, sf_dir).select(F.col("id").alias("utt_id"), F.col("score").alias("accuracy"), words.alias("words"))
    return evaluation.low_rated_words(evaluation.low_rated(a, 8.0)).withColumn("target", F.array_join("target", " "))


@query(
    """SELECT id, len(t)::INT + 2 AS n_sounds, CASE WHEN id % 4 = 0 THEN 0 ELSE 2 + id % 5 END::DOUBLE AS total, value / 10 AS human, array_to_string(list_concat(t[1:2], t), ' ') AS canonical FROM attempts""", _ATTEMPTS
)
def flattened_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("target_phonemes")
    first = F.struct(F.slice(t, 1, 2).alias("phones"), F.array(F.lit(1.0), F.lit(1.0)).alias("phones-accuracy"))
    scores = F.concat(F.array((F.col("id") % 5).cast("double")), F.array_repeat(F.lit(0.0), F.size(t) - F.when(F.col("id") % 4 == 0, 2).otherwise(1)))
    a = views.attempts(spark, sf_dir).select("id", F.array(first, F.struct(t.alias("phones"), scores.alias("phones-accuracy"))).alias("words"), F.col("value").alias("accuracy"))
    flat = evaluation.flatten_words(a)
    return flat.select("id", F.size("phone_scores").alias("n_sounds"), F.aggregate("phone_scores", F.lit(0.0), lambda s, x: s + x).alias("total"), "human", F.array_join("canonical", " ").alias("canonical"))


@query("SELECT doc_id, md5(text) AS digest, lang AS accent, quality FROM documents JOIN labels USING (doc_id)")
def annotated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the documents that have labels, written as lines and read again, against the annotations."""
    docs, labels = views.read(spark, sf_dir, "documents"), views.read(spark, sf_dir, "labels")
    folder = new_folder(spark, "predictions")
    made = docs.join(labels, "doc_id", "left_semi")
    evaluation.write_predictions(made.select(F.col("doc_id").cast("string").alias("utt_id"), F.col("source").alias("speaker"), F.col("lang").alias("accent"), "text", F.split("text", " ").alias("predicted")), folder)
    annotated = labels.join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("utt_id"), "text", "quality")
    checked = evaluation.with_annotations(evaluation.read_predictions(spark, folder), annotated)
    return checked.select(F.col("utt_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "accent", "quality")


@query("SELECT doc_id, md5(text) AS digest, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of the documents that are labelled toxic, by their places in the files."""
    path = f"{sf_dir}/documents.parquet"
    toxic = views.read(spark, sf_dir, "labels").filter("toxic = 1")
    places = cohorts.corpus_index(spark, path, ("doc_id",)).join(toxic, "doc_id")
    found = cohorts.fetch(places.select("file", "row"), cohorts.row_groups(spark, path), spark.read.parquet(path).select("doc_id", "text", "n_chars").schema)
    return found.join(toxic, "doc_id").select("doc_id", F.md5("text").alias("digest"), "n_chars", "quality")


@query(
    """SELECT 'shared' AS part, c_custkey AS key FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
       UNION ALL SELECT 'only', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"""
)
def cohort_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = views.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    parts = {"shared": cohorts.shared(c, o, "key"), "only": cohorts.difference(c, o, "key")}
    return parts["shared"].select(F.lit("shared").alias("part"), "key").unionByName(parts["only"].select(F.lit("only").alias("part"), "key"))


@query("SELECT user_id AS speaker_id, id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS accent FROM attempts WHERE user_id IN (SELECT c_custkey FROM customer)", _ATTEMPTS)
def accented_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of users who are customers; the others have no speaker's entry."""
    speakers = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("speaker_id"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("accent"))
    return cohorts.with_accents(views.attempts(spark, sf_dir).select(F.col("user_id").alias("speaker_id"), "id"), speakers)


@query(
    """SELECT id, array_to_string(list(coalesce(code, (SELECT count(*) FROM known)) ORDER BY i), ' ') AS ids FROM (SELECT id, i, h[i] AS symbol FROM heard, unnest(generate_series(1, len(h))) AS u(i))
       LEFT JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS code FROM known) USING (symbol) GROUP BY id""",
    _ATTEMPTS,
    _HEARD,
    "known AS (SELECT DISTINCT unnest(t) AS symbol FROM attempts)",
)
def encoded_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir)
    coded = encode(a.select("id", "predicted_phonemes"), "predicted_phonemes", vocabulary(a, "target_phonemes"))
    return coded.select("id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    """SELECT id, array_to_string(list_concat([CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'AE1' ELSE 'AA1' END, 'N'], list_concat(t, CASE WHEN id % 5 < 2 THEN ['IH0', 'K'] ELSE ['AH0', 'T'] END)), ' ') AS form FROM attempts""", _ATTEMPTS
)
def australian_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.array(F.lit("IH0"), F.when(F.col("id") % 5 < 2, "K").otherwise("T"))
    british = F.concat(F.array(F.lit("AA1"), F.lit("N")), "target_phonemes", last)
    american = F.array(F.when(F.col("id") % 2 == 0, "AE1").otherwise("AA1"), F.lit("N"))
    word = F.when(F.col("id") % 3 == 0, "aunt").otherwise(F.col("word"))
    a = views.attempts(spark, sf_dir).withColumns({"british": british, "american": american, "head": word})
    return a.select("id", F.array_join(australian(F.col("british"), F.col("american"), F.col("head")), " ").alias("form"))


@query(
    """SELECT word, CASE WHEN length(word) < 6 THEN 'easy' ELSE 'hard' END AS difficulty, CASE WHEN length(word) % 2 = 0 THEN upper(word) ELSE reverse(upper(word)) END AS target,
       length(word) % 2 = 1 AND word <> reverse(word) AS differs, length(word) % 3 = 0 AS recorded FROM lexicon""",
    _LEXICON,
)
def bank_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = views.toy_lexicon(spark, sf_dir)
    n = F.char_length("word")
    bank = lexicon.select("word", F.col("word").alias("seq"), F.when(n < 6, "easy").otherwise("hard").alias("difficulty"))
    recordings = lexicon.filter(n % 3 == 0).select("word", F.explode(F.array(F.lit("au"), F.lit("rp"))).alias("accent"))
    found = practice_words(bank, lexicon, "au", recordings)
    return found.select("word", "difficulty", F.array_join("target", "").alias("target"), F.col("distinct").alias("differs"), "recorded")


@query(f"""SELECT doc_id, n_phonemes AS fewest, (n_phonemes + CASE WHEN n_phonemes IS NOT NULL THEN even END)::INT AS most FROM ({ORACLE['lexicon_phonemes']}) JOIN (
       SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z'' ]+', ' ', 'g'), ' +'), lambda w: w <> '' AND length(w) % 2 = 0)) AS even FROM documents) USING (doc_id)""")
def sentence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more sound in Australian words of even length, so that the accents differ."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = views.toy_lexicon(spark, sf_dir).withColumn("au", F.array_append("au", F.lit("R")))
    return target_range(docs, lexicon, id_col="doc_id")


@query(
    """SELECT rec_id::VARCHAR AS rec_id, f::INT AS frame, round(greatest(-80.0, 10 * log10(avg(y * y))), 4) AS level_db FROM (
       SELECT rec_id, t, (pow(a, t + 1) * sum(d * pow(a, -t)) OVER (PARTITION BY rec_id ORDER BY t))::FLOAT::DOUBLE AS y, n FROM (
         SELECT rec_id, t, x - coalesce(lag(x) OVER (PARTITION BY rec_id ORDER BY t), 0) AS d, count(*) OVER (PARTITION BY rec_id) AS n, (1 / (2 * pi() * 70)) / (1 / (2 * pi() * 70) + 1 / 16000.0) AS a FROM (
           SELECT vec_id // 25 AS rec_id, vec_id % 25 * 64 + unnest(generate_series(0, 63)) AS t, unnest(embedding)::DOUBLE AS x FROM embeddings)))
       , unnest([t // 160, t // 160 - 1]) AS u(f) WHERE f >= 0 AND f * 160 + 320 <= n GROUP BY rec_id, f"""
)
def sample_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, one after the other, as recordings of 1,600 samples in three pieces."""
    e = views.read(spark, sf_dir, "embeddings")
    nth = F.col("vec_id") % 25
    rows = e.groupBy(F.floor(F.col("vec_id") / 25).alias("rec_id"), F.floor(nth / 10).cast("int").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))
    pieces = rows.select("rec_id", "piece", F.flatten(F.transform("e", lambda x: x["embedding"])).alias("samples"))
    return frame_levels_of_pieces(pieces).withColumn("level_db", F.round("level_db", 4))
