"""Registered queries of the speech jobs, and the same in DuckDB's SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions import gates
from speechjobs.functions.scoring import score_attempts
from speechjobs.functions.symbols import edits
from speechjobs.operators import cohorts, evaluation, history, ingest, totals
from speechjobs.operators import frames as frame_jobs
from speechjobs.operators.lexicon import lexicon_statistics, text_phonemes, vocabulary
from speechjobs.plans import views
from speechjobs.sources import exports

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The views of views.py in SQL.
_ATTEMPTS = """
words(word, t) AS (VALUES ('click', ['K','L','IH1','K']), ('purchase', ['P','ER1','CH','AH0','S']), ('signup', ['S','AY1','N','AH2','P']), ('view', ['V','Y','UW1']), ('error', ['EH1','R','ER0'])),
attempts AS (
  SELECT event_id AS id, user_id, ts, word, t, event_id % 5 AS n, ['ga','rp','au'][user_id % 3 + 1] AS accent, least(10.0, floor(value) / 10) AS score,
         CASE WHEN event_id % 10 = 0 THEN 'sample' ELSE 'real' END AS source, value, list_transform(t, lambda p: rtrim(p, '012')) AS s
  FROM events JOIN words ON word = event_type),
wrong AS (
  SELECT *, CASE n WHEN 1 THEN [s[1]] WHEN 2 THEN list_filter(s, lambda p, i: regexp_matches(t[i], '[012]$') AND p <> 'AH') WHEN 4 THEN list_filter(s, lambda p: p = 'R') ELSE [] END AS e FROM attempts)"""
_TAKES = """
raw AS (
  SELECT vec_id AS v, label, ['US','GB','AU','CA','IE','IN','US','GB','FR','DE'][label % 10 + 1] AS country, vec_id % 3 = 0 AS own_voice,
         CASE WHEN vec_id % 3 <> 0 THEN ['ga','rp','au'][(vec_id // 3) % 3 + 1] END AS target, vec_id % 37 AS contributor, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL),
files AS (SELECT *, 'a.json' AS path FROM raw UNION ALL SELECT *, 'b.json' FROM raw WHERE v % 17 = 0),
checked AS (
  SELECT *, CASE WHEN v % 2 = 0 THEN map {'US': 'NE', 'GB': 'SCT', 'AU': 'E', 'CA': 'ON', 'IE': 'S', 'IN': 'N'}[country] END AS region,
         CASE WHEN v % 29 = 1 THEN 'bad take id' WHEN v % 31 = 2 THEN 'labels disagree' WHEN v % 43 = 5 THEN 'made with a different model version'
              WHEN v % 37 = 3 THEN 'wrong feature length' WHEN v % 41 = 4 THEN 'feature out of range' END AS reason
  FROM files),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY path, v) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY path) AS own FROM checked WHERE reason IS NULL) WHERE own = 1),
judged AS (
  SELECT c.*, CASE WHEN c.reason IS NOT NULL THEN 'refused' WHEN f.nth > 10 THEN 'over_cap' WHEN c.path = f.path THEN 'added' ELSE 'duplicate' END AS status
  FROM checked c LEFT JOIN firsts f ON c.v = f.v AND c.reason IS NULL),
routes AS (
  SELECT 'native' AS kind, country AS key, country, contributor FROM judged WHERE status = 'added' AND own_voice
  UNION ALL SELECT 'native', country || '-' || region, country, contributor FROM judged WHERE status = 'added' AND own_voice AND region IS NOT NULL
  UNION ALL SELECT 'attempt', country || '>' || target, country, contributor FROM judged WHERE status = 'added' AND NOT own_voice)"""
_RATINGS = "ratings AS (SELECT doc_id, source, lang, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))"


def query(sql: str | None = None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return register


@query(
    """SELECT accent, count(*) AS utterances, sum(len(t))::BIGINT AS phones, sum(len(e) + (n = 3)::INT)::BIGINT AS errors, sum(len(e) + (n = 3)::INT) / sum(len(t)) AS per,
       sum(CASE WHEN n = 2 THEN len(list_filter(t, lambda p: regexp_matches(p, '[012]$') AND p <> 'AH0')) ELSE len(e) + (n = 3)::INT END) / sum(len(t)) AS per_with_stress FROM wrong GROUP BY accent""",
    _ATTEMPTS,
)
def per_by_accent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_rates(views.attempts(spark, sf_dir), ("accent",), "target_phonemes", "predicted_phonemes")


_INSIGHTS = (
    _ATTEMPTS,
    """tried AS (SELECT accent, s[i] AS sound, -id AS seen, 0 AS late, i FROM wrong, unnest(generate_series(1, len(s))) AS u(i)),
failed AS (SELECT accent, e[i] AS sound FROM wrong, unnest(generate_series(1, len(e))) AS u(i)),
sums AS (SELECT accent, sound, count(*) AS attempts, min((seen, i)) AS first FROM tried GROUP BY ALL),
found AS (SELECT s.accent, s.sound, s.attempts, coalesce(f.errors, 0) AS errors, least(1.0, coalesce(f.errors, 0) / s.attempts) AS rate, round_even(least(1.0, coalesce(f.errors, 0) / s.attempts), 2) AS error_rate, first
  FROM sums s LEFT JOIN (SELECT accent, sound, count(*) AS errors FROM failed GROUP BY ALL) f ON s.accent = f.accent AND s.sound = f.sound WHERE s.attempts >= 2),
insights AS (SELECT *, row_number() OVER (PARTITION BY accent ORDER BY error_rate DESC, attempts DESC, first)::INT AS position FROM found)""",
)


@query("SELECT accent, sound, attempts, errors, rate, error_rate, position FROM insights", *_INSIGHTS)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.insights(views.attempts_with_errors(spark, sf_dir))


@query("SELECT accent, sound, attempts, errors, error_rate, position FROM insights WHERE error_rate > 0 AND position <= 5", *_INSIGHTS)
def weak_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.weak_sounds(history.insights(views.attempts_with_errors(spark, sf_dir)))


@query(
    """SELECT accent, word, weight, focus, position FROM (SELECT *, row_number() OVER (PARTITION BY accent ORDER BY weight DESC, word)::INT AS position FROM (
       SELECT accent, word, round(sum(error_rate), 9) AS weight, array_to_string(list(sound ORDER BY pos), ' ') AS focus FROM insights JOIN bank USING (sound) WHERE error_rate > 0 AND position <= 5 GROUP BY accent, word)) WHERE position <= 6""",
    *_INSIGHTS,
    "bank AS (SELECT word, sound, min(i) AS pos FROM (SELECT word, rtrim(t[i], '012') AS sound, i FROM words, unnest(generate_series(1, len(t))) AS u(i)) GROUP BY ALL)",
)
def recommended_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts_with_errors(spark, sf_dir)
    bank = a.groupBy("word").agg(F.first("target_phonemes").alias("phonemes")).withColumn("seq", F.col("word"))
    found = history.recommend_words(history.weak_sounds(history.insights(a)), bank)
    return found.withColumn("focus", F.array_join("focus", " "))


@query("SELECT user_id, count(*) AS attempts, avg(score) AS average, max_by(id, score * 1000000000 + id) AS best_id FROM attempts GROUP BY user_id", _ATTEMPTS)
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_stats(views.attempts(spark, sf_dir)).withColumn("average", F.round("average", 9))


ORACLE["history_stats"] = ORACLE["history_stats"].replace("avg(score)", "round(avg(score), 9)")


@query(
    """SELECT user_id, word, change FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change DESC, last DESC) AS k FROM (
       SELECT user_id, word, round(max_by(score, id) - min_by(score, id), 9) AS change, max(id) AS last FROM attempts GROUP BY ALL HAVING count(*) > 1) WHERE change > 0) WHERE k = 1""",
    _ATTEMPTS,
)
def most_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).withColumn("score", F.col("score") * 10)
    return history.most_improved(a).withColumn("change", F.round(F.col("change") / 10, 9))


@query(
    """SELECT user_id, id, streak FROM (SELECT user_id, id, count(*) FILTER (score >= 8) OVER (PARTITION BY user_id, run ORDER BY id) AS streak FROM (
       SELECT *, sum((score < 8)::INT) OVER (PARTITION BY user_id ORDER BY id) AS run FROM attempts))""",
    _ATTEMPTS,
)
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.streaks(views.attempts(spark, sf_dir)).select("user_id", "id", "streak")


@query("SELECT user_id, ts::DATE AS day, count(*) AS attempts, least(1.0, count(*) / 10) AS progress FROM attempts WHERE source = 'real' GROUP BY ALL", _ATTEMPTS)
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.daily_counts(views.attempts(spark, sf_dir))


@query(
    """SELECT id, user_id, round(score - first_value(score) OVER (PARTITION BY user_id, word ORDER BY id), 9) AS change, row_number() OVER (PARTITION BY user_id ORDER BY id)::INT AS number FROM attempts""",
    _ATTEMPTS,
)
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trend(views.attempts(spark, sf_dir)).select("id", "user_id", F.round("change", 9).alias("change"), "number")


@query(
    """SELECT id, word, accent, array_to_string(t, ' ') AS target_phonemes, score, len(e) AS errors, source FROM wrong""", _ATTEMPTS
)
def history_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.attempts_with_errors(spark, sf_dir)
    out = history.history_rows(rows.withColumn("word", F.concat_ws("|", "id", "word")))
    return out.select(F.split("word", r"\|")[0].cast("long").alias("id"), F.split("word", r"\|")[1].alias("word"), "accent", "target_phonemes", "score", "errors", "source")


@query("SELECT status, reason, count(*) AS takes FROM judged GROUP BY ALL", _TAKES)
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.status_counts(_judged(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = exports.check_takes(views.takes(spark, sf_dir), views.FEATURE_SET, views.FEATURES)
    return ingest.judge(checked, spark.createDataFrame([], "digest string"), views.CAP)


@query("SELECT kind, key, count(*) AS added FROM routes GROUP BY ALL", _TAKES)
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.added_counts(ingest.routed(_judged(spark, sf_dir)))


@query(
    """SELECT country, count(*) FILTER (kind = 'native' AND key = country) AS native_total, count(*) FILTER (kind = 'native' AND key = country) AS native_added,
       count(DISTINCT key) FILTER (key LIKE '%-%')::INT AS n_regions, count(DISTINCT key) FILTER (key LIKE '%>%')::INT AS n_targets, count(DISTINCT contributor) AS contributors_this_run,
       count(*) FILTER (kind = 'native' AND key = country) >= 20 AND count(DISTINCT contributor) >= 8 AS ready FROM routes GROUP BY country""",
    _TAKES,
)
def country_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    routes = ingest.routed(judged)
    rows = ingest.country_summary(totals.totals_of(routes, views.FEATURES), ingest.added_counts(routes), judged, min_takes=20)
    return rows.select("country", "native_total", "native_added", F.size("regions").alias("n_regions"), F.size("attempts").alias("n_targets"), "contributors_this_run", "ready")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "embeddings").select(F.lit("label").alias("kind"), F.col("label").cast("string").alias("key"), F.col("embedding").alias("features"))


@query("SELECT label::VARCHAR AS key, i::INT AS i, count(*) AS n, round(sum(embedding[i + 1]::DOUBLE), 6) AS total FROM embeddings, unnest(generate_series(0, 63)) AS u(i) GROUP BY ALL")
def totals_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = totals.totals_of(_labelled(spark, sf_dir), views.FEATURES)
    return t.select("key", F.col("count").alias("n"), F.posexplode("total").alias("i", "x")).select("key", "i", "n", F.round("x", 6).alias("total"))


@query("""SELECT label::VARCHAR AS key, (i * 64 + j)::INT AS at, round(sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE), 6) AS x FROM embeddings, unnest(generate_series(0, 63)) AS u(i), unnest(generate_series(0, 63)) AS w(j) GROUP BY ALL""")
def totals_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = totals.totals_of(_labelled(spark, sf_dir), views.FEATURES)
    return t.select("key", F.posexplode("outer").alias("at", "x")).select("key", "at", F.round("x", 6).alias("x"))


def _precision(rows: str) -> str:
    """SQL of ``mu`` (accent, m) and ``precision`` (p) of the classifier of ``rows`` (accent, x): the pooled covariance is
    inverted by elimination beside a unit matrix; it is positive definite, so no rows need to be swapped."""
    return f"""
cells AS (SELECT accent, i, avg(x[i]) AS m FROM {rows}, unnest(generate_series(1, 64)) AS u(i) GROUP BY ALL),
mu AS (SELECT accent, list(m ORDER BY i) AS m FROM cells GROUP BY accent),
away AS (SELECT list_transform(list_zip(x, m), lambda z: z[1] - z[2]) AS d FROM {rows} JOIN mu USING (accent)),
pooled AS (SELECT i, j, sum(d[i] * d[j]) / (count(*) - (SELECT count(*) FROM mu)) AS c FROM away, unnest(generate_series(1, 64)) AS u(i), unnest(generate_series(1, 64)) AS w(j) GROUP BY ALL),
ridge AS (SELECT i, j, c + CASE WHEN i = j THEN 0.001::DOUBLE * (SELECT sum(c) FROM pooled WHERE i = j) / 64 ELSE 0 END AS c FROM pooled),
beside AS (SELECT i, j, c FROM ridge UNION ALL SELECT i, j + 64, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM ridge),
steps AS (
  SELECT 1 AS k, list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM beside GROUP BY i)
  UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda c, j: c - r[k] * p[j]) END)
  FROM (SELECT k, m, list_transform(m[k], lambda c: c / divisor) AS p FROM (SELECT k, m, m[k][k] AS divisor FROM steps WHERE k <= 64))),
precision AS (SELECT list_transform(m, lambda r: r[65:]) AS p FROM steps WHERE k = 65)"""


#: The distance of a vector from a mean, of d, their difference, and p.
_FAR = "list_inner_product(d, list_transform(p, lambda r: list_inner_product(r, d)))"


@query(
    f"""SELECT count(*) AS classes, round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg((accent = nearest)::INT) AS r FROM (
       SELECT v, any_value(accent) AS accent, arg_min(guess, far) AS nearest FROM (
         SELECT v, accent, guess, {_FAR} AS far FROM (SELECT v, t.accent, mu.accent AS guess, list_transform(list_zip(x, m), lambda z: z[1] - z[2]) AS d, p FROM labelled t, mu, precision)) GROUP BY v) GROUP BY accent)""",
    "RECURSIVE labelled AS (SELECT vec_id AS v, label::VARCHAR AS accent, embedding::DOUBLE[] AS x FROM embeddings)",
    _precision("labelled"),
)
def classify_from_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _labelled(spark, sf_dir)
    model = totals.fit_classifier(totals.totals_of(vectors, views.FEATURES))
    return cohorts.balanced_accuracy(totals.classify(vectors, model), "key").withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query(
    f"""SELECT key, takes, kind, target, accent, round_even(far, 2) AS distance, closest, CASE WHEN target IN ('ga', 'rp') THEN closest = target END AS lands_on_target FROM (
       SELECT *, first_value(accent) OVER (PARTITION BY key ORDER BY round_even(far, 2), accent) AS closest FROM (
         SELECT key, accent, count(*) AS takes, CASE WHEN own_voice THEN 'native' ELSE 'attempt' END AS kind, any_value(target) AS target, avg(far) AS far FROM (
           SELECT key, accent, own_voice, target, {_FAR} AS far FROM (
             SELECT key, own_voice, target, accent, list_transform(list_zip(x, m), lambda z: z[1] - z[2]) AS d, p FROM placed, mu, precision)) GROUP BY key, accent, own_voice))""",
    "RECURSIVE " + _TAKES.strip(),
    """placed AS (
  SELECT own_voice, CASE WHEN NOT own_voice THEN target END AS target, embedding::DOUBLE[] AS x,
         unnest(CASE WHEN NOT own_voice THEN [country || '>' || target] WHEN region IS NULL THEN [country] ELSE [country, country || '-' || region] END) AS key FROM judged WHERE status = 'added'),
reference AS (SELECT CASE label WHEN 0 THEN 'ga' ELSE 'rp' END AS accent, embedding::DOUBLE[] AS x FROM embeddings WHERE label IN (0, 1))""",
    _precision("reference"),
)
def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = ingest.routed(_judged(spark, sf_dir))
    reference = _labelled(spark, sf_dir).filter("key in ('0', '1')").withColumn("key", F.when(F.col("key") == "0", "ga").otherwise("rp"))
    report = totals.landing_report(totals.totals_of(routes, views.FEATURES), totals.totals_of(reference, views.FEATURES), views.FEATURES)
    return report.select("key", "takes", "kind", "target", F.explode("distance_to").alias("accent", "distance"), "closest", "lands_on_target")


@query()
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component, with its sign, and the power of the first eight."""
    vectors = views.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("stats"))
    turned = totals.project(vectors, totals.fit_projection(vectors, 64, 8))
    power = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return turned.select("vec_id", F.round(F.col("features")[0], 6).alias("lead"), F.round(power, 6).alias("power"))


@query(
    """SELECT take_id, frame, token, round(1 / total, 6) AS top, round((1 - exp(second - peak)) / total, 6) AS lead, n_frames FROM (
       SELECT *, list_sum(list_transform(l, lambda x: exp(x - peak))) AS total, list_reverse_sort(l)[2] AS second FROM (
       SELECT *, lag(token) OVER (PARTITION BY take_id ORDER BY frame) AS before, count(*) OVER (PARTITION BY take_id) AS n_frames FROM (
       SELECT vec_id // 25 AS take_id, (vec_id % 25)::INT AS frame, embedding::DOUBLE[] AS l, list_max(embedding::DOUBLE[]) AS peak, (list_position(embedding, list_max(embedding)) - 1)::INT AS token FROM embeddings))
       WHERE token IS DISTINCT FROM before AND token <> 0)"""
)
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir).withColumn("logits", F.col("logits").cast("array<double>"))
    return frame_jobs.collapse(frames, 0).withColumns({"top": F.round("top", 6), "lead": F.round("lead", 6)})


@query(
    """SELECT take_id, coalesce(phonemes, '') AS phonemes, coalesce(starts, '') AS starts, coalesce(ends, '') AS ends, round(coalesce(confidence, 0), 6) AS confidence, round(coalesce(margin, 0), 6) AS margin FROM (SELECT DISTINCT take_id FROM won)
       LEFT JOIN (SELECT take_id, string_agg('S' || token, ' ' ORDER BY frame) AS phonemes, string_agg(2 * frame, ' ' ORDER BY frame) AS starts, string_agg(2 * until, ' ' ORDER BY frame) AS ends FROM (
         SELECT *, coalesce(lead(frame) OVER (PARTITION BY take_id ORDER BY frame), least(frame + 6, n_frames)) AS until FROM kept WHERE token <> 63) GROUP BY take_id) USING (take_id)
       LEFT JOIN (SELECT take_id, avg(1 / total) AS confidence, avg((1 - exp(second - peak)) / total) AS margin FROM kept GROUP BY take_id) USING (take_id)""",
    """won AS (SELECT vec_id // 25 AS take_id, (vec_id % 25)::INT AS frame, embedding::DOUBLE[] AS l, list_max(embedding::DOUBLE[]) AS peak, (list_position(embedding, list_max(embedding)) - 1)::INT AS token FROM embeddings)""",
    """kept AS (SELECT *, list_sum(list_transform(l, lambda x: exp(x - peak))) AS total, list_reverse_sort(l)[2] AS second FROM (
       SELECT *, lag(token) OVER (PARTITION BY take_id ORDER BY frame) AS before, count(*) OVER (PARTITION BY take_id) AS n_frames FROM won) WHERE token IS DISTINCT FROM before AND token <> 0)""",
)
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir).withColumn("logits", F.col("logits").cast("array<double>"))
    found = frame_jobs.decode(frames, {i: f"S{i}" for i in range(64)}, (63,), 0)
    hundredths = lambda side: F.array_join(F.transform("spans", lambda s: F.round(s[side] * 100).cast("int").cast("string")), " ").alias(f"{side}s")
    return found.select("take_id", F.array_join("phonemes", " ").alias("phonemes"), hundredths("start"), hundredths("end"), F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


_LEVELS = """levels AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (least(floor(value), 79) - 80)::DOUBLE AS level_db FROM events),
facts AS (SELECT rec_id, len(s) AS n, s[floor(0.1 * (len(s) - 1))::INT + 1] AS floor, s[floor(0.95 * (len(s) - 1))::INT + 1] AS peak FROM (SELECT rec_id, list_sort(list(level_db)) AS s FROM levels GROUP BY rec_id)),
base AS (SELECT * FROM levels JOIN facts USING (rec_id)),
islands AS (SELECT *, frame - row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS island FROM base WHERE level_db > greatest(floor + 6, peak - 32)),
runs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rec_id, island) AS size FROM islands) WHERE size >= 4),
marked AS (SELECT *, (coalesce(frame - lag(frame) OVER (PARTITION BY rec_id ORDER BY frame) > 35, true))::INT AS fresh FROM runs),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY frame) AS part FROM marked),
parts AS (SELECT rec_id, part, min(frame) AS first, max(frame) AS last, count(*) AS size FROM numbered GROUP BY ALL),
solid AS (SELECT *, max(size) OVER (PARTITION BY rec_id) AS most FROM parts),
regions AS (SELECT rec_id, min(first) AS first, max(last) AS last FROM solid WHERE size >= 12 OR size = most GROUP BY rec_id)"""


@query(
    """SELECT rec_id, min(frame)::INT AS first, max(frame)::INT AS last, bool_or(speech) AS found FROM (
       SELECT b.rec_id, b.frame, CASE WHEN n < 4 THEN false WHEN peak - floor < 6 THEN floor > -35 ELSE coalesce(b.frame BETWEEN r.first AND r.last, false) END AS speech
       FROM base b LEFT JOIN regions r USING (rec_id)) WHERE speech GROUP BY rec_id""",
    _LEVELS,
)
def speech_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = frame_jobs.speech_frames(views.levels(spark, sf_dir)).filter("speech")
    return marked.groupBy("rec_id").agg(F.min("frame").cast("int").alias("first"), F.max("frame").cast("int").alias("last"), F.max("found").alias("found"))


@query(
    """SELECT rec_id, found AS found_speech, CASE WHEN found THEN greatest(0, a * 160 - pad) ELSE 0 END::INT AS start, CASE WHEN found THEN least(n_samples, least(n_samples, b * 160 + 320) + pad) ELSE n_samples END::INT AS end,
       CASE WHEN found THEN round_even((least(n_samples, b * 160 + 320) - a * 160) / 16000, 3) ELSE 0.0 END::DOUBLE AS speech_seconds,
       CASE WHEN found THEN round_even(greatest(0.0, least(60.0, 10 * log10(power) - CASE WHEN len(o) >= 4 THEN o[floor(0.5 * (len(o) - 1))::INT + 1] ELSE floor END)), 1) ELSE 0.0 END::DOUBLE AS snr_db
       FROM (SELECT rec_id, bool_or(speech) AS found, min(frame) FILTER (speech) AS a, max(frame) FILTER (speech) AS b, avg(pow(10.0, level_db / 10)) FILTER (speech) AS power,
             coalesce(list_sort(list(level_db) FILTER (NOT speech)), []) AS o, any_value(floor) AS floor, (count(*) - 1) * 160 + 320 AS n_samples, @PAD@ AS pad FROM (
             SELECT b.*, CASE WHEN n < 4 THEN false WHEN peak - floor < 6 THEN floor > -35 ELSE coalesce(b.frame BETWEEN r.first AND r.last, false) END AS speech FROM base b LEFT JOIN regions r USING (rec_id)) GROUP BY rec_id)""".replace("@PAD@", str(int(frame_jobs.PAD * frame_jobs.SAMPLE_RATE))),
    _LEVELS,
)
def take_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = views.levels(spark, sf_dir)
    lengths = levels.groupBy("rec_id").agg(((F.count("*") - 1) * frame_jobs.HOP + frame_jobs.FRAME).cast("int").alias("n_samples"))
    return frame_jobs.take_quality(levels, lengths)


_LEXICON = """
split AS (SELECT item_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z'' ]+', ' ', 'g'), ' +'), lambda w: w <> '')) AS word FROM benchmark),
lexicon AS (SELECT DISTINCT word FROM split)"""


@query(
    """SELECT doc_id, CASE WHEN min(pos) FILTER (missing) IS NULL THEN coalesce(sum(length(word)), 0)::INT END AS n_phonemes, arg_min(word, pos) FILTER (missing) AS unknown_word FROM (
       SELECT d.doc_id, d.pos, d.word, d.word IS NOT NULL AND l.word IS NULL AS missing FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word, unnest(CASE WHEN len(ws) = 0 THEN [0] ELSE generate_series(1, len(ws)) END) AS pos FROM (
           SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z'' ]+', ' ', 'g'), ' +'), lambda w: w <> '') AS ws FROM documents)) d LEFT JOIN lexicon l ON d.word = l.word) GROUP BY doc_id""",
    _LEXICON,
)
def lexicon_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("au").alias("accent"))
    found = text_phonemes(docs, views.toy_lexicon(spark, sf_dir), id_col="doc_id")
    return found.select("doc_id", F.size("phonemes").alias("n_phonemes"), "unknown_word").withColumn("n_phonemes", F.when(F.col("unknown_word").isNull(), F.col("n_phonemes")))


@query("SELECT count(*) AS words, count(*) FILTER (word <> reverse(word)) AS differing, count(*) FILTER (length(word) % 2 = 0) AS australian FROM lexicon", _LEXICON)
def lexicon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_statistics(views.toy_lexicon(spark, sf_dir))


@query("SELECT symbol, (row_number() OVER (ORDER BY late, symbol) - 1)::INT AS id FROM (SELECT DISTINCT unnest(t) AS symbol, 0 AS late FROM attempts UNION ALL SELECT '[UNK]', 1 UNION ALL SELECT '[PAD]', 2)", _ATTEMPTS)
def symbol_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(views.attempts(spark, sf_dir), "target_phonemes")


@query(
    """SELECT n::BIGINT AS variant, 'exact' AS rule, threshold::INT AS threshold, count(*) AS n, round(avg((100.0 * (len(t) - len(e)) / len(t) >= threshold)::INT), 9) AS kept FROM wrong, unnest([30, 40, 50, 60, 70, 80]) AS u(threshold) GROUP BY ALL""",
    _ATTEMPTS,
)
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.attempts(spark, sf_dir).withColumn("variant", F.col("id") % 5)
    rates = evaluation.pass_rates(evaluation.counted_measures(pairs, ("variant",), "target_phonemes", "predicted_phonemes"), ("variant",))
    return rates.filter("rule = 'exact'").withColumn("kept", F.round("kept", 9))



_HEARD = """
heard AS (SELECT id, word, t, s, n, CASE n WHEN 0 THEN t WHEN 1 THEN t[2:] WHEN 2 THEN list_transform(t, lambda p: CASE WHEN regexp_matches(p, '[012]$') THEN 'AH0' ELSE p END)
          WHEN 3 THEN list_append(t, 'T') ELSE list_transform(t, lambda p: CASE WHEN p = 'R' THEN 'L' ELSE p END) END AS h FROM attempts)"""
_PLACED = """
known AS (SELECT DISTINCT array_to_string(s, ' ') AS w, len(s) AS length FROM attempts),
ring AS (SELECT a.w, b.w AS other, row_number() OVER (PARTITION BY a.w ORDER BY b.length, b.w) - 1 AS k, count(*) OVER (PARTITION BY a.w) AS total FROM known a JOIN known b ON abs(b.length - a.length) <= 0.25 * a.length),
mispaired AS (
  SELECT h.id, h.n, o.other, h.h, own.total FROM heard h JOIN ring own ON own.w = array_to_string(h.s, ' ') AND own.other = own.w
  LEFT JOIN ring o ON own.total > 1 AND o.w = own.w AND o.k = (own.k + 1 + (h.id * 31) % nullif(own.total - 1, 0)) % own.total)"""

def _listed(sounds: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sounds) + ")"


_ALIKE = " OR ".join(f"(t[i] IN {_listed(g)} AND h[j] IN {_listed(g)})" for g in (K.VOWELS, *K.CONSONANT_GROUPS))
#: Pairs by group, then the walk back through each distinct pair: the costs are edit distances of what stands before.
_CHOICE = f"""
grouped AS (SELECT grp, t, h, count(*) AS n FROM (SELECT 'variant ' || n AS grp, s AS t, list_transform(h, lambda p: rtrim(p, '012')) AS h FROM heard
  UNION ALL SELECT 'wrong', string_split(other, ' '), list_transform(h, lambda p: rtrim(p, '012')) FROM mispaired WHERE other IS NOT NULL) GROUP BY ALL),
spelled AS (SELECT t, h, array_to_string(list_transform(t, lambda p: chr((64 + list_position(every, p))::INT)), '') AS a, array_to_string(list_transform(h, lambda p: chr((64 + list_position(every, p))::INT)), '') AS b
  FROM (SELECT DISTINCT t, h, {[*K.CONSONANTS, *K.VOWELS]} AS every FROM grouped)),
walk AS (
  SELECT t, h, a, b, length(a)::INT AS i, length(b)::INT AS j, 0 AS same, 0 AS other, 0 AS close FROM spelled
  UNION ALL SELECT t, h, a, b, i - (step <> 'insert')::INT, j - (step <> 'delete')::INT, same + (step = 'across' AND t[i] = h[j])::INT, other + (step = 'across' AND t[i] <> h[j])::INT,
    close + (step <> 'insert' AND (t[i] IN {_listed(K.UNSCORABLE)} OR (step = 'across' AND (t[i] = h[j] OR {_ALIKE}))))::INT
  FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND here = levenshtein(left(a, i - 1), left(b, j - 1)) + (t[i] <> h[j])::INT THEN 'across' WHEN i > 0 AND here = levenshtein(left(a, i - 1), left(b, j)) + 1 THEN 'delete' ELSE 'insert' END AS step
    FROM (SELECT *, levenshtein(left(a, i), left(b, j)) AS here FROM walk WHERE i > 0 OR j > 0))),
shares AS (SELECT grp, n, unnest(['exact', 'same_class', 'any_sound']) AS rule, unnest([1, 2, 3]) AS place, unnest([100.0::DOUBLE * same / len(t), round_even(100.0::DOUBLE * close / len(t), 0), 100.0::DOUBLE * (same + other) / len(t)]) AS share FROM grouped JOIN walk USING (t, h) WHERE i = 0 AND j = 0),
kept AS (SELECT grp, rule, place, threshold, sum(CASE WHEN share >= threshold THEN n ELSE 0 END) / sum(n) AS kept FROM shares, unnest([30, 40, 50, 60, 70, 80]) AS u(threshold) GROUP BY ALL)"""


@query(
    """SELECT rule, threshold::INT AS threshold, round(separation, 9) AS separation FROM (SELECT rule, place, threshold, avg(kept) FILTER (grp <> 'wrong') - max(kept) FILTER (grp = 'wrong') AS separation FROM kept GROUP BY ALL) ORDER BY round(separation, 9) DESC, place, threshold LIMIT 1""",
    "RECURSIVE " + _ATTEMPTS.strip(),
    _HEARD,
    _PLACED,
    _CHOICE,
)
def match_rule_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.attempts(spark, sf_dir).select("id", F.col("target_phonemes").alias("target"), F.col("predicted_phonemes").alias("heard"))
    wrong = evaluation.wrong_targets(pairs).filter("target is not null")
    both = pairs.withColumn("group", F.concat(F.lit("variant "), (F.col("id") % 5).cast("string"))).unionByName(wrong.withColumn("group", F.lit("wrong")))
    return evaluation.choose_rule(evaluation.pass_rates(evaluation.counted_measures(both, ("group",)), ("group",)), "group", "wrong").withColumn("separation", F.round("separation", 9))


@query("SELECT id, other AS target, array_to_string(h, ' ') AS heard FROM mispaired", _ATTEMPTS, _HEARD, _PLACED)
def wrong_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.attempts(spark, sf_dir).select("id", F.col("target_phonemes").alias("target"), F.col("predicted_phonemes").alias("heard"))
    return evaluation.wrong_targets(pairs).select("id", F.array_join("target", " ").alias("target"), F.array_join("heard", " ").alias("heard"))


@query(
    """SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.01), 9) AS p1, round(quantile_cont(value, 0.05), 9) AS p5, round(quantile_cont(value, 0.5), 9) AS median, round(avg((value < 5)::INT), 9) AS below_5, round(avg((value < 20)::INT), 9) AS below_20 FROM events GROUP BY event_type"""
)
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.spread(views.read(spark, sf_dir, "events"), "value", (5.0, 20.0), ("event_type",))
    return s.withColumns({c: F.round(c, 9) for c in ("p1", "p5", "median", "below_5", "below_20")})


@query(
    """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS false_alarm_rate, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, tp + fn AS positives, fp + tn AS negatives FROM (
       SELECT count(*) FILTER (n_chars < 600 AND quality = 0) AS tp, count(*) FILTER (n_chars < 600 AND quality <> 0) AS fp, count(*) FILTER (n_chars >= 600 AND quality = 0) AS fn, count(*) FILTER (n_chars >= 600 AND quality <> 0) AS tn FROM ratings)""",
    _RATINGS,
)
def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = views.ratings(spark, sf_dir).select((F.col("n_chars") < 600).alias("flagged"), (F.col("quality") == 0).alias("wrong"))
    return evaluation.detection(flags).withColumn("f1", F.round("f1", 9))


@query(
    """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS false_alarm_rate, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, tp + fn AS positives, fp + tn AS negatives FROM (
       SELECT count(*) FILTER (f AND w) AS tp, count(*) FILTER (f AND NOT w) AS fp, count(*) FILTER (NOT f AND w) AS fn, count(*) FILTER (NOT f AND NOT w) AS tn FROM (
       SELECT (n = 1 AND i = 1) OR (n = 2 AND regexp_matches(t[i], '[012]$') AND s[i] <> 'AH') OR (n = 4 AND t[i] = 'R') AS f, (id + i - 1) % 4 < 3 AS w FROM attempts, unnest(generate_series(1, len(t))) AS u(i)))""",
    _ATTEMPTS,
)
def sound_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).withColumn("scores", F.transform("target_phonemes", lambda p, i: ((F.col("id") + i) % 4) / 2.0))
    return evaluation.detection(evaluation.sound_flags(a, "target_phonemes", "predicted_phonemes", "scores")).withColumn("f1", F.round("f1", 9))


@query("SELECT source, count(*) AS n, round(corr(quality, n_chars), 6) AS pearson, round(avg(abs(quality - n_chars)), 6) AS mae FROM ratings GROUP BY source", _RATINGS)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(views.ratings(spark, sf_dir), "quality", "n_chars", ("source",)).withColumns({"pearson": F.round("pearson", 6), "mae": F.round("mae", 6)})


_GUESSES = "guessed AS (SELECT doc_id, source, lang AS label, ['de','en','es','fr'][n_chars % 4 + 1] AS prediction FROM documents)"


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    return views.read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("label"), F.element_at(langs, (F.col("n_chars") % 4 + 1).cast("int")).alias("prediction"))


@query("SELECT label, count(*) FILTER (prediction = 'de') AS de, count(*) FILTER (prediction = 'en') AS en, count(*) FILTER (prediction = 'es') AS es, count(*) FILTER (prediction = 'fr') AS fr FROM guessed GROUP BY label", _GUESSES)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.confusion_matrix(_guessed(spark, sf_dir), ["de", "en", "es", "fr"])


@query("SELECT count(*) AS classes, round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg((label = prediction)::INT) AS r FROM guessed GROUP BY label)", _GUESSES)
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.balanced_accuracy(_guessed(spark, sf_dir)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query("SELECT source, prediction AS vote FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM (SELECT source, prediction, count(*) AS n, min(doc_id) AS f FROM guessed GROUP BY ALL)) WHERE k = 1", _GUESSES)
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.majority_votes(_guessed(spark, sf_dir), "source", "doc_id")


@query(
    """SELECT speaker_id, accent, CASE WHEN test THEN 'test' WHEN row_number() OVER (PARTITION BY accent, test ORDER BY speaker_id) <= 2 THEN 'dev' ELSE 'train' END AS split FROM (
       SELECT *, row_number() OVER (PARTITION BY accent ORDER BY speaker_id) % 4 = 0 AS test FROM (SELECT DISTINCT user_id AS speaker_id, accent FROM attempts))""",
    _ATTEMPTS,
)
def speaker_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.splits(views.attempts(spark, sf_dir).select(F.col("user_id").alias("speaker_id"), "accent").distinct())


@query(
    """SELECT user_id AS speaker_id, id AS utt_id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k FROM attempts WHERE value >= 0.5 AND word <> 'view') WHERE k <= 20""", _ATTEMPTS
)
def usable_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).select(F.col("user_id").alias("speaker_id"), F.col("id").alias("utt_id"), F.when(F.col("word") != "view", "mic1").otherwise("mic2").alias("microphone"), F.col("value").alias("seconds"))
    return cohorts.usable_takes(a, 20).select("speaker_id", "utt_id")


@query(
    """SELECT count(*) AS utterances, round(sum(errors) / sum(len(t)), 9) AS per_one, round(sum(CASE WHEN id % 3 = 0 THEN 1 ELSE errors END) / sum(len(t)), 9) AS per_two,
       count(*) FILTER (id % 3 = 0 AND h <> t[:len(t) - 1]) AS changed, round(avg(abs(score - CASE WHEN id % 3 = 0 THEN 5 ELSE score END)) * 10, 6) AS score_gap, round(avg((abs(value - value * 0.5::DOUBLE) + (id % 4)) / 2), 6) AS feature_gap
       FROM (SELECT heard.id, heard.t, h, score, value, len(e) + (wrong.n = 3)::INT AS errors FROM heard JOIN wrong USING (id))""",
    _ATTEMPTS,
    _HEARD,
)
def run_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run hears every third target without its last sound, with another score; features differ everywhere."""
    a, third, t = views.attempts(spark, sf_dir), F.col("id") % 3 == 0, F.col("target_phonemes")
    one = a.select(F.col("id").alias("utt_id"), t.alias("reference"), F.col("predicted_phonemes").alias("heard"), "score", F.array("value", F.lit(0.0)).alias("features"))
    heard = F.when(third, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(F.col("predicted_phonemes"))
    two = a.select(F.col("id").alias("utt_id"), heard.alias("heard"), F.when(third, 5.0).otherwise(F.col("score")).alias("score"), F.array(F.col("value") * 0.5, (F.col("id") % 4).cast("double")).alias("features"))
    r = evaluation.compare_runs(one, two)
    return r.withColumns({c: F.round(c, 9 if c.startswith("per") else 6) for c in ("per_one", "per_two", "score_gap", "feature_gap")})


@query(
    """SELECT 'clean' AS condition, 'raw' AS variant, count(*) AS n, round(sum(errors) / sum(len(t)), 9) AS per, 0.0::DOUBLE AS score_gap FROM both_runs UNION ALL
       SELECT 'noise', word, count(*), round(sum(least(errors, 1)) / sum(len(t)), 9), round(avg(abs(score - value / 10)), 6) FROM both_runs WHERE id % 7 <> 0 GROUP BY word""",
    _ATTEMPTS,
    "both_runs AS (SELECT *, len(e) + (n = 3)::INT AS errors FROM wrong)",
)
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean run hears what the view says; with noise one sound is wrong where any was, and some utterances are missing."""
    a = views.attempts(spark, sf_dir).withColumn("once", F.when(edits(F.col("target_phonemes"), F.col("predicted_phonemes")) > 0, F.concat(F.array(F.lit("ZH")), F.slice("target_phonemes", F.lit(2), F.size("target_phonemes") - 1))).otherwise(F.col("target_phonemes")))
    run = lambda rows, cond, variant, heard, score: rows.select(F.col("id").alias("utt_id"), F.lit(cond).alias("condition"), variant.alias("variant"), F.col("target_phonemes").alias("reference"), F.col(heard).alias("heard"), score.alias("score"))
    runs = run(a, "clean", F.lit("raw"), "predicted_phonemes", F.col("value") / 10).unionByName(run(a.filter("id % 7 <> 0"), "noise", F.col("word"), "once", F.col("score")))
    return evaluation.condition_table(runs, ("clean", "raw")).withColumns({"per": F.round("per", 9), "score_gap": F.round("score_gap", 6)})


@query(
    """SELECT expected, heard, count(*) AS n FROM (SELECT unnest(e) AS expected, CASE n WHEN 2 THEN 'AH' ELSE 'L' END AS heard FROM wrong WHERE n IN (2, 4)) GROUP BY ALL ORDER BY n DESC, expected, heard LIMIT 15""", _ATTEMPTS
)
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusions(evaluation.operation_counts(views.attempts(spark, sf_dir), (), "target_phonemes", "predicted_phonemes"))


@query(
    """SELECT sound AS expected, count(*) AS n, round(coalesce(any_value(f.k), 0) / count(*), 9) AS error_rate FROM (SELECT unnest(s) AS sound FROM wrong) LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT unnest(e) AS x FROM wrong) GROUP BY x) f ON x = sound GROUP BY sound""",
    _ATTEMPTS,
)
def sound_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sound_rates(evaluation.operation_counts(views.attempts(spark, sf_dir), (), "target_phonemes", "predicted_phonemes")).withColumn("error_rate", F.round("error_rate", 9))


@query(
    """SELECT id, round_even((len(e) + (n = 3)::INT) / len(t), 2) AS wer, round_even(100.0 * (len(t) - len(e)) / len(t), 0)::INT AS accuracy, len(e) AS n_errors, len(e) = 0 AS faultless FROM wrong""", _ATTEMPTS
)
def scored_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).select("id", F.col("target_phonemes").alias("target"), F.col("predicted_phonemes").alias("predicted"), F.lit(0.8).alias("confidence"), F.lit(0.7).alias("margin"))
    r = score_attempts(a)
    return r.select("id", "result.wer", F.col("result.metrics.accuracy").alias("accuracy"), F.size("result.errors").cast("long").alias("n_errors"), (F.size("result.errors") == 0).alias("faultless"))


@query(
    f"""SELECT id, (reason IS NULL) AS stored, reason, coalesce(len_extra, false) AS retake FROM (
       SELECT id, len_extra, CASE WHEN user_id % 7 = 0 THEN '"Help it learn" is off' WHEN user_id % 11 = 0 THEN 'no country in your profile, so the take cannot be placed in a region'
         WHEN user_id % 13 = 0 THEN 'this device already holds {K.MAX_STORED} takes, the most it keeps' WHEN len_few THEN 'too few sounds heard' WHEN len_extra THEN 'extra sounds, likely background noise'
         WHEN len(names) > 0 THEN 'did not pass: ' || array_to_string(names, ', ') END AS reason FROM (
       SELECT id, user_id, h < ceil(0.5 * len(t)) AS len_few, h > floor(CASE WHEN id % 3 = 0 THEN {K.VIABILITY["longest_voice"]} ELSE {K.VIABILITY["longest_practice"]} END * len(t)) AS len_extra,
              list_filter([CASE WHEN id % 17 = 0 OR value / 40 < 0.25 THEN 'speech found' END, CASE WHEN value < 20 THEN 'quiet background' END, CASE WHEN id % 11 > 5 THEN 'not clipped' END, CASE WHEN id % 13 / 13 < 0.5 THEN 'model was confident' END,
                           CASE WHEN id % 3 <> 0 AND id * 7 % 100 < 30 THEN 'recognisably the target word' END, CASE WHEN id % 19 < 2 THEN 'summary is well formed' END], lambda x: x IS NOT NULL) AS names
       FROM (SELECT *, id % 9 AS h FROM attempts)))""",
    _ATTEMPTS,
)
def take_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check and every reason of a device fails for some takes."""
    a, i, user = views.attempts(spark, sf_dir), F.col("id"), F.col("user_id")
    quality = F.struct((i % 17 != 0).alias("foundSpeech"), (F.col("value") / 40).alias("speechSeconds"), F.col("value").alias("snrDb"), (i % 11 / 1000).alias("clipped"))
    n = F.size("target_phonemes")
    features = F.when(i % 19 == 0, F.array(F.lit(float("nan")))).when(i % 19 == 1, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0)))
    checks = gates.viability(quality, i % 13 / 13, i % 3 == 0, (i * 7 % 100).cast("double"), (i % 9).cast("int"), n, n, features, 1)
    able = gates.eligibility(user % 7 != 0, F.when(user % 11 != 0, "GB").otherwise(""), F.when(user % 13 == 0, K.MAX_STORED).otherwise(0))
    return a.select("id", gates.decision(checks, able).alias("d")).select("id", "d.*")


@query(
    """SELECT accent, count(*) AS takes, count(*) FILTER (value <= 0) AS without_speech, round(avg((id % 6 < 2 OR (value > 0 AND (id % 6) / (value / 10) < 1))::INT), 9) AS silent, round(quantile_cont((id % 6) / (value / 10), 0.01) FILTER (value > 0), 9) AS rate_p1, round(quantile_cont((id % 6) / (value / 10), 0.5) FILTER (value > 0), 9) AS rate_median FROM attempts GROUP BY accent""",
    _ATTEMPTS,
)
def speaking_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.attempts(spark, sf_dir).select("accent", (F.col("id") % 6).alias("sounds"), (F.col("value") / 10).alias("speech_seconds"))
    return evaluation.rate_summary(a, ("accent",)).withColumns({c: F.round(c, 9) for c in ("silent", "rate_p1", "rate_median")})


@query("SELECT word, count(*) AS n, round(avg((id % 9 < ceil(0.5 * len(t)))::INT), 9) AS too_few, round(avg((id % 9 > floor(1.5 * len(t)))::INT), 9) AS extra, round(avg((id % 9 < ceil(0.5 * len(t)) OR id % 9 > floor(1.5 * len(t)))::INT), 9) AS dropped FROM attempts GROUP BY word", _ATTEMPTS)
def length_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("target_phonemes")
    a = views.attempts(spark, sf_dir).select("word", n.alias("fewest"), n.alias("most"), (F.col("id") % 9).alias("heard"))
    return evaluation.length_drops(a, ("word",)).withColumns({c: F.round(c, 9) for c in ("too_few", "extra", "dropped")})


@query(
    """SELECT user_id AS run, max(event_id) AS max_steps, max(value) FILTER (event_type = 'purchase') AS learning_rate, round_even(arg_max(value, event_id) FILTER (event_type = 'click'), 3) AS final_train_loss,
       round_even(arg_max(value, event_id) FILTER (event_type = 'view'), 3) AS final_eval_loss, round_even(min(value) FILTER (event_type = 'view'), 3) AS best_eval_loss FROM events GROUP BY user_id"""
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    none = F.lit(None).cast("int")
    logs = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), none.alias("global_step"), none.alias("epochs"), none.alias("batch_size"), F.col("event_id").alias("pos"), F.col("event_id").alias("step"), pick("click").alias("loss"), pick("view").alias("eval_loss"), pick("purchase").alias("learning_rate"))
    return cohorts.training_summary(logs).select("run", "max_steps", "learning_rate", "final_train_loss", "final_eval_loss", "best_eval_loss")


@query(r"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)")
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exports.plain_text(F.col("html"))
    return views.read(spark, sf_dir, "pages").select("page_id", F.char_length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_decisions(views.read(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


@query("SELECT accent, sum(len(e) + (n = 3)::INT)::BIGINT AS errors, sum(len(t))::BIGINT AS words, round(sum(len(e) + (n = 3)::INT) / sum(len(t)), 9) AS wer, round(greatest(0, (1 - sum(len(e) + (n = 3)::INT) / sum(len(t))) * 10), 9) AS score FROM wrong GROUP BY accent", _ATTEMPTS)
def word_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechjobs.functions.symbols import strip_all

    a = views.attempts(spark, sf_dir).withColumns({"r": strip_all(F.col("target_phonemes")), "h": strip_all(F.col("predicted_phonemes"))})
    return evaluation.word_error_rates(a, ("accent",), "r", "h").withColumns({"wer": F.round("wer", 9), "score": F.round("score", 9)})


@query(
    """SELECT id AS utt_id, unnest([0, 1])::INT AS nth, unnest([array_to_string(t[1:2], ' '), array_to_string(t[3:], ' ')]) AS target,
       unnest(CASE WHEN n = 1 THEN [array_to_string(h[1:1], ' '), array_to_string(h[2:], ' ')] ELSE [array_to_string(h[1:2], ' '), array_to_string(h[3:], ' ')] END) AS heard FROM heard""",
    _ATTEMPTS,
    _HEARD,
)
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("target_phonemes")
    a = views.attempts(spark, sf_dir).select(F.col("id").alias("utt_id"), F.array(F.slice(t, 1, 2), F.slice(t, F.lit(3), F.size(t))).alias("words"), F.col("predicted_phonemes").alias("predicted"))
    return evaluation.cut_words(a).withColumns({"target": F.array_join("target", " "), "heard": F.array_join("heard", " ")})


@query(
    """SELECT label AS speaker, vec_id // 100 AS utt, w AS window, (d - 1)::INT AS dim, round(avg(embedding[d]::DOUBLE), 6) AS mean, round(stddev_samp(embedding[d]::DOUBLE), 6) AS std FROM (
       SELECT *, unnest(list_filter([0, CASE WHEN vec_id % 100 < 50 THEN 1 END, CASE WHEN vec_id % 100 BETWEEN greatest(0, floor((n - 50) / 2)) AND greatest(0, floor((n - 50) / 2)) + 49 THEN 2 END, CASE WHEN vec_id % 100 >= n - 50 THEN 3 END], lambda x: x IS NOT NULL)) AS w FROM (
       SELECT *, count(*) OVER (PARTITION BY label, vec_id // 100) AS n FROM embeddings)), unnest(generate_series(1, 64)) AS u(d) GROUP BY ALL"""
)
def pooled_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.read(spark, sf_dir, "embeddings").select(F.col("label").alias("speaker"), F.floor(F.col("vec_id") / 100).alias("utt"), F.lit(0).alias("layer"), (F.col("vec_id") % 100).alias("frame"), F.col("embedding").cast("array<double>").alias("hidden"))
    return frame_jobs.pool_layers(f).select("speaker", "utt", "window", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 9) AS mean, max(k)::INT AS most FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 40 GROUP BY l_returnflag")
def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.read(spark, sf_dir, "lineitem").withColumns({"id": F.col("l_linenumber"), "created": F.col("l_orderkey")})
    kept = history.stored_within_cap(lines, "l_suppkey", "created", K.MAX_TAKES_PER_CONTRIBUTOR)
    numbered = kept.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")))
    return numbered.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 9).alias("mean"), F.max("k").alias("most"))
