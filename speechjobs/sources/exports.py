"""Export files of contributed takes: reading, validating, auditing, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.gates import home_accent, route
from speechjobs.functions.symbols import table

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Stands for a bare NaN or Infinity, which JSON parsers refuse; a string is no number, so the take fails as it should.
NOT_A_NUMBER = '"not a number"'
#: Keys that no export may hold.
AUDIO_KEYS = "(?i)samples|wav|audio|blob|recording"


def read_files(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(path, value) of a JSON file, or of all files below a folder whose name fits ``names``."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def _kind(v: Column, path: str | None = None) -> Column:
    return F.schema_of_variant(v if path is None else F.variant_get(v, path, "variant"))


def parse_files(files: DataFrame, app: str) -> tuple[DataFrame, DataFrame]:
    """(path, pos, take VARIANT) of the export files of ``app``, and (path, reason) of skipped files.

    Bare NaN and Infinity are let through as strings. Order is carried as path and position.
    """
    marked = F.regexp_replace("value", r"(?<=[:,\[\s])-?(?:NaN|Infinity)(?=\s*[,\]}])", NOT_A_NUMBER)
    parsed = files.select("path", F.coalesce(F.try_parse_json("value"), F.try_parse_json(marked)).alias("doc"))
    text = lambda p: F.try_variant_get("doc", p, "string")
    version = F.when(_kind(F.col("doc"), "$.version").isin("BIGINT", "DOUBLE") | _kind(F.col("doc"), "$.version").startswith("DECIMAL"), F.try_variant_get("doc", "$.version", "double"))
    is_text = lambda p: _kind(F.col("doc"), p) == "STRING"
    good = (
        _kind(F.col("doc")).startswith("OBJECT") & is_text("$.app") & (text("$.app") == app) & is_text("$.kind") & (text("$.kind") == K.EXPORT_KIND)
        & (version == K.EXPORT_VERSION) & _kind(F.col("doc"), "$.takes").startswith("ARRAY")
    )
    judged = parsed.withColumn("reason", F.when(F.col("doc").isNull(), "invalid json").when(~F.coalesce(good, F.lit(False)), "unrecognised file"))
    takes = judged.filter("reason is null").select("path", F.posexplode(F.try_variant_get("doc", "$.takes", "array<variant>")).alias("pos", "take"))
    return takes, judged.filter("reason is not null").select("path", "reason")


def check_takes(takes: DataFrame, feature_set: str, feature_count: int = K.FEATURES) -> DataFrame:
    """(path, pos, take VARIANT) -> path, pos, reason (the first that fails, else null) and the cleaned columns."""
    v = F.col("take")
    kind = lambda p: F.coalesce(_kind(v, p), F.lit("VOID"))
    text = lambda p: F.when(kind(p) == "STRING", F.try_variant_get(v, p, "string"))
    flag = lambda p: F.when(kind(p) == "BOOLEAN", F.try_variant_get(v, p, "boolean"))
    parsed = takes.select("path", "pos", "take", text("$.id").alias("id"), text("$.contributor").alias("contributor"), text("$.country").alias("raw_country"), F.upper(text("$.country")).alias("country"), kind("$.region").alias("region_kind"), text("$.region").alias("region"), flag("$.natural_voice").alias("natural"), flag("$.matches_home_accent").alias("matches"), kind("$.target_accent").alias("accent_kind"), text("$.target_accent").alias("accent"), text("$.model_version").alias("version"), kind("$.features").alias("features_kind"), F.when(kind("$.features").startswith("ARRAY"), F.try_variant_get(v, "$.features", "array<variant>")).alias("raw"))
    numeric = lambda x: F.coalesce(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    number = lambda x: F.try_variant_get(x, "$", "double")
    parsed = parsed.withColumn("features", F.when(F.forall("raw", numeric), F.transform("raw", number)))
    bad = lambda test: ~F.coalesce(test, F.lit(False))
    finite = F.forall("features", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    natural, accent_void = F.col("natural"), F.col("accent_kind") == "VOID"
    rules = [
        (bad(_kind(v).startswith("OBJECT")), "not a take"),
        (bad(F.col("id").rlike(UUID)), "bad take id"),
        (bad(F.col("contributor").rlike(UUID)), "bad contributor id"),
        (bad(F.col("raw_country").rlike("^[A-Za-z]{2}$")), "bad country"),
        ((F.col("region_kind") != "VOID") & bad(F.array_contains(table(K.REGIONS)[F.col("country")], F.col("region"))), "bad region"),
        (natural.isNull() | F.col("matches").isNull(), "bad labels"),
        (F.when(natural, ~accent_void).otherwise(bad(F.col("accent").isin(*K.ACCENTS))), "bad target accent"),
        (F.col("matches") != home_accent(F.col("country"), F.col("accent"), natural), "labels disagree"),
        (bad(F.col("version") == feature_set), "made with a different model version"),
        (bad(F.size("raw") == feature_count), "wrong feature length"),
        (bad(finite), "non-finite feature"),
        (F.exists("features", lambda x: F.abs(x) > K.MAX_ABS_FEATURE), "feature out of range"),
    ]
    reason = F.coalesce(*[F.when(test, name) for test, name in rules])
    return parsed.select("path", "pos", reason.alias("reason"), F.lower("id").alias("id"), F.lower("contributor").alias("contributor"), "country", "region", F.col("accent").alias("target_accent"), F.col("natural").alias("natural_voice"), F.col("matches").alias("matches_home_accent"), "features")


def audit(checked: DataFrame, takes: DataFrame) -> DataFrame:
    """For each take of an export: the reason ingest would refuse it, whether it holds audio-like keys, and its route."""
    keys = takes.select("path", "pos", F.exists(F.coalesce(F.json_object_keys(F.to_json("take")), F.array().cast("array<string>")), lambda k: k.rlike(AUDIO_KEYS)).alias("holds_audio"))
    where = F.when(F.col("reason").isNull(), route(F.col("country"), F.col("region"), F.col("target_accent"), F.col("natural_voice")))
    return checked.join(keys, ["path", "pos"]).select("path", "pos", "reason", "holds_audio", where.alias("route"))


def compare_labels(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null-safe comparison of expected and actual labels of each case: (key, differing columns)."""
    e, a = expected.alias("e"), actual.alias("a")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in columns]))
    return e.join(a, key, "full").select(key, differ.alias("differing"))


def export_document(takes: DataFrame, app: str, exported: str) -> DataFrame:
    """(contributor, value): one export document for each contributor, takes in the order of their time."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col("created").alias("__at"), F.col("id").alias("__id"), F.struct(*takes.columns).alias("take")))), lambda s: s["take"])
    made = F.struct(F.lit(app).alias("app"), F.lit(K.EXPORT_KIND).alias("kind"), F.lit(K.EXPORT_VERSION).alias("version"), F.lit(exported).alias("exported"), body.alias("takes"))
    return takes.groupBy("contributor").agg(F.to_json(made, {"ignoreNullFields": "false"}).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One text file set for each contributor."""
    documents.repartition("contributor").write.partitionBy("contributor").text(path)


def write_lines(takes: DataFrame, path: str) -> None:
    """Takes as newline-delimited JSON, for bulk use."""
    takes.write.json(path, ignoreNullFields=False)


def pick_recordings(candidates: DataFrame, default_author: str) -> DataFrame:
    """The first candidate with a permitted licence for each (word, accent); author without markup.

    ``candidates``: word, accent, seq, license, author, url.
    """
    allowed = candidates.filter(F.col("license").rlike(r"(?i)^(cc0|cc[ -]by|public domain|pd)"))
    first = allowed.groupBy("word", "accent").agg(F.min_by(F.struct("license", "author", "url"), "seq").alias("r"))
    author = plain_text(F.col("r.author"))
    return first.select("word", "accent", "r.license", "r.url", F.coalesce(F.nullif(author, F.lit("")), F.lit(default_author)).alias("author"))


def plain_text(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))


def coverage(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("accent").agg(F.count("*").alias("recordings"))
