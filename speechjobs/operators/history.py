"""Practice history: insights, statistics, goals, streaks, exports and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.symbols import strip_all, strip_stress
from speechjobs.sources.shared import written

ATTEMPT = (
    "id long, user_id long, word string, accent string, target_phonemes array<string>, predicted_phonemes array<string>, score double, wer double, "
    "errors array<struct<type:string,index:int,expected:array<string>,heard:array<string>,tip:string>>, timestamp timestamp, source string"
)
MIN_ATTEMPTS = 2
DAILY_GOAL = 10


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append scored attempts, by date; source is 'real' unless given."""
    rows = attempts.withColumns({"source": F.coalesce("source", F.lit("real")), "date": F.to_date("timestamp")})
    rows.write.mode("append").partitionBy("date").parquet(path)


def seed_if_empty(attempts: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's attempts, marked 'sample', where there are none yet."""
    return attempts.unionByName(sample.withColumn("source", F.lit("sample"))) if attempts.isEmpty() else attempts


def scope(attempts: DataFrame, accent: str | None = None, band: str | None = None, source: str | None = None) -> DataFrame:
    """Attempts of an accent (missing: ga), of a score band ('high' from 8, 'low' under 5), of a source."""
    out = attempts
    if accent:
        out = out.filter(F.coalesce("accent", F.lit("ga")) == accent)
    if band:
        out = out.filter(F.col("score") >= 8 if band == "high" else F.col("score") < 5)
    return out.filter(F.col("source") == source) if source else out


def cleared(attempts: DataFrame, source: str | None = None) -> DataFrame:
    """What stays when history is cleared, all of it or one source."""
    return attempts.filter(F.col("source") != source) if source else attempts.limit(0)


def newest(attempts: DataFrame, limit: int) -> DataFrame:
    return attempts.orderBy(F.desc("id")).limit(limit)


def insights(attempts: DataFrame, keys: tuple[str, ...] = ("accent",)) -> DataFrame:
    """Attempts and errors of each sound by ``keys``: (keys, sound, attempts, errors, rate, error_rate, position).

    Sounds with two attempts or more, sorted in ``position`` by rounded rate, then attempts, then the sound that the
    newest attempt shows first. Attempts of the same sounds and errors are counted before they are taken apart.
    """
    rows = attempts.select(*keys, "id", strip_all(F.col("target_phonemes")).alias("t"), strip_all(F.flatten(F.transform("errors", lambda e: e["expected"]))).alias("e"))
    base = rows.groupBy(*keys, "t", "e").agg(F.count("*").alias("n"), F.max("id").alias("id"))
    zero = F.lit(0).cast("long")
    order = F.struct((-F.col("id")).alias("id"), F.lit(0).alias("late"), "pos")
    tried = base.select(*keys, "id", "n", F.posexplode("t").alias("pos", "sound")).select(*keys, "sound", order.alias("seen"), F.col("n").alias("a"), zero.alias("e"))
    late = F.struct((-F.col("id")).alias("id"), F.lit(1).alias("late"), "pos")
    wrong = base.select(*keys, "id", "n", F.posexplode("e").alias("pos", "sound")).select(*keys, "sound", late.alias("seen"), zero.alias("a"), F.col("n").alias("e"))
    sums = tried.unionByName(wrong).groupBy(*keys, "sound").agg(F.sum("a").alias("attempts"), F.sum("e").alias("errors"), F.min("seen").alias("seen"))
    rate = F.least(F.lit(1.0), F.col("errors") / F.col("attempts"))
    kept = sums.filter(F.col("attempts") >= MIN_ATTEMPTS).withColumns({"rate": rate, "error_rate": F.bround(rate, 2)})
    place = Window.partitionBy(*keys).orderBy(F.desc("error_rate"), F.desc("attempts"), "seen")
    return kept.withColumn("position", F.row_number().over(place)).drop("seen")


def weak_sounds(found: DataFrame, keys: tuple[str, ...] = ("accent",), most: int = 5) -> DataFrame:
    """The weakest sounds that have errors: the first ``most`` of insights()."""
    return found.filter((F.col("error_rate") > 0) & (F.col("position") <= most)).select(*keys, "sound", "attempts", "errors", "error_rate", "position")


def recommend_words(weak: DataFrame, bank: DataFrame, keys: tuple[str, ...] = ("accent",), most: int = 6) -> DataFrame:
    """Words to practise: (keys, word, weight, focus, position). The weight sums the rates of the weak sounds in a word.

    ``bank``: word, seq, phonemes. Ties go by seq.
    """
    sounds = bank.select("word", "seq", F.posexplode(F.array_distinct(strip_all(F.col("phonemes")))).alias("pos", "sound"))
    hits = weak.select(*keys, "sound", "error_rate").join(sounds, "sound")
    words = hits.groupBy(*keys, "word", "seq").agg(F.round(F.sum("error_rate"), 9).alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sound"))), lambda s: s["sound"]).alias("focus"))
    place = Window.partitionBy(*keys).orderBy(F.desc("weight"), "seq")
    return words.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= most).drop("seq")


def history_stats(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, attempts, average, best_id): the best attempt is the newest one of the highest score."""
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.avg("score").alias("average"), F.max_by("id", F.struct("score", "id")).alias("best_id"))


def most_improved(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, word, change): the word with the largest rise from the first to the last score, of words tried twice or more;
    ties go to the word of the newest attempt."""
    words = attempts.groupBy(key, "word").agg(F.count("*").alias("n"), (F.max_by("score", "id") - F.min_by("score", "id")).alias("change"), F.max("id").alias("last"))
    rising = words.filter("n > 1 and change > 0")
    return rising.groupBy(key).agg(F.max_by(F.struct("word", "change"), F.struct("change", "last")).alias("b")).select(key, "b.word", "b.change")


def trend(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """Score change of each attempt against the word's first, and the attempt's number, oldest first."""
    word = Window.partitionBy(key, "word").orderBy("id")
    return attempts.withColumns({"change": F.col("score") - F.first("score").over(word), "number": F.row_number().over(Window.partitionBy(key).orderBy("id"))})


def streaks(attempts: DataFrame, key: str = "user_id", pass_score: float = 8.0) -> DataFrame:
    """Attempts in a row with at least ``pass_score``, counted at each attempt."""
    order = Window.partitionBy(key).orderBy("id")
    resets = attempts.withColumn("__run", F.sum((F.col("score") < pass_score).cast("int")).over(order))
    hits = Window.partitionBy(key, "__run").orderBy("id")
    return resets.withColumn("streak", F.sum((F.col("score") >= pass_score).cast("int")).over(hits)).drop("__run")


def daily_counts(attempts: DataFrame, key: str = "user_id", goal: int = DAILY_GOAL) -> DataFrame:
    """Real attempts of each day, and the progress to the daily goal (at most 1)."""
    days = attempts.filter(F.col("source") == "real").groupBy(key, F.to_date("timestamp").alias("day")).agg(F.count("*").alias("attempts"))
    return days.withColumn("progress", F.least(F.lit(1.0), F.col("attempts") / goal))


def marks(attempts: DataFrame) -> DataFrame:
    """``marks``: for each target sound its status, what was heard and the tip, rebuilt from the stored errors."""

    def one(p: Column, i: Column) -> Column:
        e = F.get(F.filter("errors", lambda x: x["index"] == i), F.lit(0))
        status = F.when(e["type"] == "delete", "missed").when(e["type"].isNotNull(), "error").otherwise("correct")
        return F.struct(p.alias("phoneme"), status.alias("status"), F.get(e["heard"], F.lit(0)).alias("heard"), e["tip"].alias("tip"))

    return attempts.withColumn("marks", F.transform("target_phonemes", one))


def latest_decisions(decisions: DataFrame, session: str = "session", order: str = "at", most: int = 30) -> DataFrame:
    place = Window.partitionBy(session).orderBy(F.desc(order))
    return decisions.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= most).drop("__n")


def history_rows(attempts: DataFrame) -> DataFrame:
    """The columns of a CSV export: arrays joined by spaces, errors as a count, accent ga where missing."""
    joined = lambda c: F.concat_ws(" ", c)
    return attempts.select("timestamp", "word", F.coalesce("accent", F.lit("ga")).alias("accent"), joined("target_phonemes").alias("target_phonemes"), joined("predicted_phonemes").alias("predicted_phonemes"), "score", "wer", F.coalesce(F.size("errors"), F.lit(0)).alias("errors"), "source")


def write_csv(attempts: DataFrame, path: str) -> None:
    history_rows(attempts).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def backup(attempts: DataFrame, path: str) -> None:
    attempts.write.json(path, ignoreNullFields=False)


def backup_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of backup files, one document each."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def import_backup(spark: SparkSession, path: str, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """import_documents() of all backup files of a path."""
    return import_documents(backup_files(spark, path), existing)


def import_documents(documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rejected paths) of backup documents (path, value) {"attempts": [...]}.

    A document counts only if all of its attempts are valid. Rows whose timestamp and word exist already are left out; rows
    that repeat inside a document are all added. Oldest first. Each document is read and parsed once.
    """
    kind = lambda v, p: F.coalesce(F.schema_of_variant(F.variant_get(v, p, "variant")), F.lit("VOID"))
    parsed = documents.select("path", F.try_parse_json("value").alias("doc"))
    listed = parsed.select("path", F.when(kind(F.col("doc"), "$.attempts").startswith("ARRAY"), F.try_variant_get("doc", "$.attempts", "array<variant>")).alias("attempts"))
    numeric = lambda a: kind(a, "$.score").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    texts = lambda a: (kind(a, "$.word") == "STRING") & (kind(a, "$.timestamp") == "STRING")
    lists = lambda a: kind(a, "$.target_phonemes").startswith("ARRAY") & kind(a, "$.predicted_phonemes").startswith("ARRAY") & kind(a, "$.errors").startswith("ARRAY")
    fine = F.coalesce(F.forall("attempts", lambda a: F.coalesce(numeric(a) & texts(a) & lists(a), F.lit(False))), F.lit(False))
    judged = written(listed.select("path", F.when(fine, F.col("attempts")).alias("attempts")), "backups")
    get = lambda p, t: F.try_variant_get("a", p, t).alias(p[2:])
    rows = judged.select("path", F.posexplode("attempts").alias("pos", "a")).select("path", "pos", get("$.word", "string"), get("$.accent", "string"), get("$.target_phonemes", "array<string>"), get("$.predicted_phonemes", "array<string>"), get("$.score", "double"), get("$.wer", "double"), get("$.timestamp", "string"), get("$.source", "string"))
    have = existing.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "word")
    fresh = rows.withColumn("timestamp", F.try_to_timestamp("timestamp")).join(have, ["timestamp", "word"], "left_anti")
    return fresh.orderBy("timestamp", "path", "pos"), judged.filter("attempts is null").select("path")


def stored_within_cap(takes: DataFrame, device: str = "contributor", order: str = "created", most: int = K.MAX_STORED) -> DataFrame:
    """The first takes of each device."""
    place = Window.partitionBy(device).orderBy(order, "id")
    return takes.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= most).drop("__n")


def expected_sounds(errors: Column) -> Column:
    return F.flatten(F.transform(errors, lambda e: F.transform(e["expected"], strip_stress)))
