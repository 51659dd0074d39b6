"""Domain views on the TPC-H-like, event and text tables: attempts, takes, frames, levels, words.

The same definitions in SQL, for DuckDB, stand in queries.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.align import align_ops, once_per_pair
from speechjobs.functions.gates import home_accent
from speechjobs.functions.symbols import strip_all, table, tip
from speechjobs.operators.lexicon import normalised_words

WORDS = {"click": "K L IH1 K", "purchase": "P ER1 CH AH0 S", "signup": "S AY1 N AH2 P", "view": "V Y UW1", "error": "EH1 R ER0"}
COUNTRIES = ("US", "GB", "AU", "CA", "IE", "IN", "US", "GB", "FR", "DE")
SOME_REGION = {"US": "NE", "GB": "SCT", "AU": "E", "CA": "ON", "IE": "S", "IN": "N"}
FEATURE_SET, FEATURES, CAP = "m1", 64, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts at five words: heard as written, without the first sound, with vowels as AH, with a T added, or
    with R as L."""
    e = read(spark, sf_dir, "events")
    target = F.split(table(WORDS)[F.col("event_type")], " ")
    n = F.col("event_id") % 5
    heard = (
        F.when(n == 0, target).when(n == 1, F.slice(target, F.lit(2), F.size(target) - 1)).when(n == 2, F.transform(target, lambda p: F.when(p.rlike("[012]$"), "AH0").otherwise(p)))
        .when(n == 3, F.array_append(target, F.lit("T"))).otherwise(F.transform(target, lambda p: F.when(p == "R", "L").otherwise(p)))
    )
    accent = F.element_at(F.array(*map(F.lit, K.ACCENTS)), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("word"), accent.alias("accent"), target.alias("target_phonemes"), heard.alias("predicted_phonemes"),
        F.least(F.lit(10.0), F.floor("value") / 10).alias("score"), F.when(F.col("event_id") % 10 == 0, "sample").otherwise("real").alias("source"), "value",
    )


def attempts_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def errors(pairs: DataFrame) -> DataFrame:
        aligned = pairs.withColumn("al", align_ops(strip_all(F.col("ref")), strip_all(F.col("hyp"))))
        wrong = F.filter("al.ops", lambda o: o["kind"].isin("substitute", "delete"))
        sound = lambda o: F.get("ref", o["ref_index"])
        return aligned.withColumn("errors", F.transform(wrong, lambda o: F.struct(o["kind"].alias("type"), o["ref_index"].alias("index"), F.array(sound(o)).alias("expected"), F.array_compact(F.array(F.get("hyp", o["hyp_index"]))).alias("heard"), tip(sound(o)).alias("tip"))))

    return once_per_pair(attempts(spark, sf_dir), "target_phonemes", "predicted_phonemes", errors, "errors").withColumn("wer", F.lit(0.0))


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, take VARIANT): embeddings as exported takes, a fixed share of them faulty, and some repeated in a second
    file."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id is not null and embedding is not null and label is not null")
    v = F.col("vec_id")
    uuid = lambda n, head: F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), F.lit(f"-{head}-4000-8000-000000000000"))
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("label") % 10 + 1).cast("int"))
    natural = v % 3 == 0
    target = F.when(~natural, F.element_at(F.array(*map(F.lit, K.ACCENTS)), (F.floor(v / 3) % 3 + 1).cast("int")))
    label = F.coalesce(home_accent(country, target, natural), F.lit(False))
    features = F.transform("embedding", lambda x: x.cast("double"))
    features = F.when(v % 37 == 3, F.slice(features, 1, FEATURES - 1)).when(v % 41 == 4, F.concat(F.array(F.lit(99.0)), F.slice(features, 2, FEATURES - 1))).otherwise(features)
    body = F.struct(
        F.when(v % 29 == 1, "bad").otherwise(uuid(v, "0000")).alias("id"), uuid(v % 37, "c000").alias("contributor"), country.alias("country"), F.when(v % 2 == 0, table(SOME_REGION)[country]).alias("region"), natural.alias("natural_voice"),
        F.when(v % 31 == 2, ~label).otherwise(label).alias("matches_home_accent"), target.alias("target_accent"), F.when(v % 43 == 5, "m0").otherwise(FEATURE_SET).alias("model_version"), features.alias("features"),
    )
    documents = e.select(v.alias("v"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
    files = F.explode(F.when(F.col("v") % 17 == 0, F.array(F.lit("a.json"), F.lit("b.json"))).otherwise(F.array(F.lit("a.json"))))
    return documents.select(files.alias("path"), F.col("v").cast("int").alias("pos"), F.parse_json("json").alias("take"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("take_id"), (F.col("vec_id") % 25).cast("int").alias("frame"), F.col("embedding").alias("logits"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level for every event of a user, in the order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(order) - 1).alias("frame"), (F.least(F.floor("value"), F.lit(79)) - 80).cast("double").alias("level_db"))


def toy_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark, spelled by their letters; rp is spelled backward, au exists for words of even length."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(normalised_words(F.col("text"))).alias("word")).distinct()
    letters = F.split(F.upper("word"), "")
    return words.select("word", letters.alias("ga"), F.reverse(letters).alias("rp"), F.when(F.char_length("word") % 2 == 0, letters).alias("au"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "lang", "quality", "toxic", "n_chars")
