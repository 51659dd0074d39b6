"""Corpora, speakers and splits; evaluation of predicted labels; training logs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def corpus_index(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Metadata columns of all Parquet files of a corpus with each row's file and place; other columns are not read."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, first, rows): which rows of each Parquet file stand in which of its row groups. Only the footers are
    read, each by a task."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                with _opened(file) as parquet:
                    rows = [parquet.metadata.row_group(g).num_rows for g in range(parquet.metadata.num_row_groups)]
                first = list(accumulate(rows, initial=0))[:-1]
                yield pa.RecordBatch.from_pydict({"file": [file] * len(rows), "row_group": pa.array(range(len(rows)), pa.int32()), "first": pa.array(first, pa.int64()), "rows": pa.array(rows, pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("_metadata.file_path").alias("file"))
    return files.mapInArrow(footers, "file string, row_group int, first long, rows long")


def fetch(places: DataFrame, groups: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows at ``places`` (file, row; see corpus_index), with the columns of ``schema``; ``groups`` are row_groups().

    A task reads the columns of one row group at a time, and of no other than those in which a place lies. A place that is
    given twice is one row; a place that no file has gives none; an empty table of places gives an empty table.
    """
    near = groups.withColumnRenamed("file", "__file")
    inside = (F.col("file") == F.col("__file")) & (F.col("row") >= F.col("first")) & (F.col("row") < F.col("first") + F.col("rows"))
    wanted = places.select("file", "row").join(near, inside).groupBy("file", "row_group").agg(F.collect_set((F.col("row") - F.col("first")).cast("long")).alias("at"))
    columns = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, group, at in zip(*(batch[c].to_pylist() for c in ("file", "row_group", "at")), strict=True):
                with _opened(file) as parquet:
                    yield from parquet.read_row_group(group, columns=columns).select(columns).take(sorted(at)).to_batches(1024)

    return wanted.mapInArrow(read, schema)


def _opened(file: str) -> pq.ParquetFile:
    """A file by the address that Spark gives it."""
    system, path = fs.FileSystem.from_uri(file)
    return pq.ParquetFile(path, filesystem=system)


def read_manifest(spark: SparkSession, path: str, metadata: DataFrame, key: str = "utt_id") -> DataFrame:
    """Manifest lines "utt_id path" with the annotation of the utterance; lines without one are dropped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") >= 2)
    return parts.select(F.col("p")[0].alias(key), F.col("p")[1].alias("path")).join(metadata, key)


def with_accents(utterances: DataFrame, speakers: DataFrame, key: str = "speaker_id") -> DataFrame:
    return utterances.join(speakers, key)


def splits(speakers: DataFrame, group: str = "accent", speaker: str = "speaker_id") -> DataFrame:
    """``split`` of each speaker: every fourth of a group is held out, the first two of the rest are for development."""
    place = Window.partitionBy(group).orderBy(speaker)
    numbered = speakers.withColumn("__n", F.row_number().over(place))
    rest = numbered.withColumn("__test", F.col("__n") % 4 == 0).withColumn("__r", F.row_number().over(Window.partitionBy(group, "__test").orderBy(speaker)))
    return rest.withColumn("split", F.when(F.col("__test"), "test").when(F.col("__r") <= 2, "dev").otherwise("train")).drop("__n", "__test", "__r")


def every_fifth(speakers: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Development speakers of the score head: the first of every five. Speakers are few; ids alone are sorted."""
    place = Window.orderBy(speaker)
    return speakers.select(speaker).distinct().withColumn("n", F.row_number().over(place)).filter("n % 5 = 1").drop("n")


def usable_takes(utterances: DataFrame, most: int = 60, microphone: str = "mic1", least_seconds: float = 0.5) -> DataFrame:
    """The first ``most`` utterances of each speaker from one microphone, of half a second or more."""
    place = Window.partitionBy("speaker_id").orderBy("utt_id")
    fit = utterances.filter((F.col("microphone") == microphone) & (F.col("seconds") >= least_seconds))
    return fit.withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= most).drop("__n")


def difference(all_: DataFrame, without: DataFrame, key: str) -> DataFrame:
    return all_.join(without.select(key), key, "left_anti")


def shared(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    return one.select(key).intersect(two.select(key))


def balanced_accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean recall over the classes that occur."""
    recalls = rows.groupBy(label).agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("recall"))
    return recalls.agg(F.count("*").alias("classes"), F.avg("recall").alias("balanced_accuracy"))


def confusion_matrix(rows: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(label).pivot(prediction, classes).count().na.fill(0)


def majority_votes(rows: DataFrame, speaker: str = "speaker", order: str = "seq", prediction: str = "prediction") -> DataFrame:
    """Each speaker's most frequent prediction; the one met first wins ties."""
    counts = rows.groupBy(speaker, prediction).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(speaker).agg(F.max_by(prediction, F.struct("n", (-F.col("first")).alias("f"))).alias("vote"))


def guesses(rows: DataFrame, group: str, prediction: str = "prediction") -> DataFrame:
    """How predictions spread over the classes for each group that was never trained."""
    counts = rows.groupBy(group, prediction).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def training_summary(logs: DataFrame) -> DataFrame:
    """One row for each run: steps, learning rate, last losses in log order (3 digits), best evaluation loss."""
    last = lambda c: F.bround(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))), 3)
    g = logs.groupBy("run").agg(
        F.coalesce(F.nullif(F.max("global_step"), F.lit(0)), F.max("step")).alias("max_steps"), F.max("epochs").alias("epochs"), F.max("batch_size").alias("batch_size"), F.max("learning_rate").alias("learning_rate"),
        last("loss").alias("final_train_loss"), last("eval_loss").alias("final_eval_loss"), F.bround(F.min("eval_loss"), 3).alias("best_eval_loss"), F.count("pos").alias("entries"),
    )
    return g.withColumn("optimizer", F.when(F.col("entries") > 0, "AdamW")).drop("entries")


def loss_series(logs: DataFrame) -> DataFrame:
    """(run, step, name, value) of all losses and learning rates, for plotting."""
    return logs.unpivot(["run", "pos", "step"], ["loss", "eval_loss", "learning_rate"], "name", "value").filter("value is not null")
