"""Mergeable totals of feature vectors (count, sum, sum of outer products), and what follows from them alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechjobs.operators.cohorts import splits
from speechjobs.sources.runs import RunLog
from speechjobs.sources.shared import written

SCHEMA = "kind string, key string, count long, total array<double>, outer array<double>"


def partial_totals(vectors: DataFrame, features: int) -> DataFrame:
    """Totals of each key within each task, from (kind, key, features).

    Each Arrow batch is one matrix product for each key; a task holds one matrix for each key it meets. Only these
    partial totals are shuffled, so a key with most of the rows costs no more than any other.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch["kind"].to_pylist(), batch["key"].to_pylist(), strict=True))
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), features)
            distinct = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            which = np.array([distinct[k] for k in keys])
            for k, i in distinct.items():
                own = x[which == i]
                held = state.setdefault(k, [0, np.zeros(features), np.zeros((features, features))])
                held[0] += len(own)
                held[1] += own.sum(0)
                held[2] += own.T @ own
        if state:
            yield _as_batch(state)

    return vectors.select("kind", "key", F.col("features").cast("array<double>").alias("features")).mapInArrow(fold, SCHEMA)


def _as_batch(state: dict[tuple, list]) -> pa.RecordBatch:
    """Totals by (kind, key) as one batch of SCHEMA; vectors and matrices go as flat buffers, without a Python list."""
    rows = list(state.values())

    def lists(column: int) -> pa.ListArray:
        flat = np.concatenate([np.ravel(v[column]) for v in rows])
        ends = np.cumsum([0, *(np.size(v[column]) for v in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64()))

    names = [pa.array([k[i] for k in state], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*names, pa.array([v[0] for v in rows], pa.int64()), lists(1), lists(2)], ["kind", "key", "count", "total", "outer"])


def _added(table: pa.Table) -> pa.Table:
    """One row of SCHEMA for the rows of one key."""
    rows = table.num_rows
    total, outer = (table[c].combine_chunks().flatten().to_numpy().reshape(rows, -1).sum(0) for c in ("total", "outer"))
    batch = _as_batch({(table["kind"][0].as_py(), table["key"][0].as_py()): [sum(table["count"].to_pylist()), total, outer]})
    return pa.Table.from_batches([batch])


def merge_totals(*parts: DataFrame) -> DataFrame:
    """Sum of totals by (kind, key), whatever their order.

    Whole rows are added as arrays, in two levels: the partial totals of a key meet in as many groups as the root of their
    tasks' number, then those groups meet. So no task holds more than that many matrices, and nothing is exploded.
    """
    rows = reduce(DataFrame.unionByName, [p.select("kind", "key", "count", "total", "outer") for p in parts])
    groups = max(1, round(rows.sparkSession.sparkContext.defaultParallelism ** 0.5))
    some = rows.groupBy("kind", "key", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")).applyInArrow(_added, SCHEMA)
    return some.groupBy("kind", "key").applyInArrow(_added, SCHEMA)


def totals_of(vectors: DataFrame, features: int) -> DataFrame:
    return merge_totals(partial_totals(vectors, features))


def save_totals(totals: DataFrame, path: str, feature_set: str) -> None:
    totals.withColumn("feature_set", F.lit(feature_set)).write.mode("overwrite").partitionBy("feature_set", "kind").parquet(path)


def load_totals(spark: SparkSession, path: str, feature_set: str) -> DataFrame:
    """Stored totals; refuses a store of another feature set."""
    stored = spark.read.schema(f"{SCHEMA}, feature_set string").parquet(path)
    _only(stored, feature_set, path)
    return stored.drop("feature_set")


class TotalsLog:
    """Totals that grow by runs or stream batches, each counted exactly once.

    A batch stores only its own totals, under its number: one that is replayed takes its own place. total() adds all
    batches; compact() makes one of them, so that a look-up reads few.
    """

    def __init__(self, spark: SparkSession, path: str, feature_set: str):
        self.runs, self.feature_set = RunLog(spark, path, f"{SCHEMA}, feature_set string"), feature_set

    def add(self, totals: DataFrame, run: int, last: int | None = None) -> None:
        self.runs.write(totals.withColumn("feature_set", F.lit(self.feature_set)), run, last)

    def total(self, before: int | None = None) -> DataFrame:
        """Totals of all runs, or of those before ``before``; refuses a log of another feature set."""
        stored = self.runs.read(before)
        _only(stored, self.feature_set, self.runs.path)
        return merge_totals(stored)

    def compact(self) -> None:
        runs = self.runs.folders()
        if len(runs) > 1:
            self.add(self.total(), min(runs)[0], max(r[1] for r in runs))
            self.runs.drop_replaced()


def _only(stored: DataFrame, feature_set: str, path: str) -> None:
    others = stored.filter(~F.col("feature_set").eqNullSafe(F.lit(feature_set))).select("feature_set").limit(1).collect()
    if others:
        raise ValueError(f"{path} was built with model {others[0][0]}; start a new totals store for {feature_set}")


#: Keys whose means are with the tasks at one time.
KEYS_AT_ONCE = 4096


@dataclass(frozen=True)
class Classifier:
    """Linear discriminant as a table: ``means`` holds a row (key, mean) for each key. ``whiten`` is features by features;
    with it, distances are plain ones, for its product with itself is the inverse of the pooled covariance."""

    means: DataFrame
    whiten: np.ndarray

    @property
    def precision(self) -> np.ndarray:
        return self.whiten.T @ self.whiten

    def blocks(self, size: int = KEYS_AT_ONCE) -> Iterator[tuple[list[str], np.ndarray]]:
        """Keys in order and their whitened means, at most ``size`` at a time."""
        rest = self.means
        while rows := rest.sort("key").limit(size).collect():
            yield [r["key"] for r in rows], np.array([r["mean"] for r in rows]) @ self.whiten.T
            if len(rows) < size:
                return
            rest = self.means.filter(F.col("key") > rows[-1]["key"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scatter of vectors about the means of their keys: one row of SCHEMA a task, with the number of keys as its total."""
    state = [0, np.zeros(1), None]
    for batch in batches:
        for n, total, outer in zip(*(batch[c] for c in ("count", "total", "outer")), strict=True):
            s = total.values.to_numpy()
            scatter = outer.values.to_numpy().reshape(len(s), len(s)) - np.outer(s, s) / n.as_py()
            state = [state[0] + n.as_py(), state[1] + 1, scatter if state[2] is None else state[2] + scatter]
    if state[0]:
        yield _as_batch({("within", ""): state})


def fit_classifier(totals: DataFrame, min_count: int = 1) -> Classifier | None:
    """Classifier of the keys of ``totals`` (of one kind) with at least ``min_count`` vectors; None for fewer than two.

    The totals of each key become its scatter in a task, and scatters are added in two levels: one matrix comes to the
    driver, whatever the number of keys. The means stay a table. Rows without a key are no class.
    """
    classes = totals.filter((F.col("count") >= max(min_count, 1)) & F.col("key").isNotNull()).select("kind", "key", "count", "total", "outer")
    classes = written(classes, "classes")
    pooled = merge_totals(classes.mapInArrow(_within, SCHEMA)).first()
    if pooled is None or pooled["total"][0] < 2:
        return None
    f = round(len(pooled["outer"]) ** 0.5)
    within = np.array(pooled["outer"]).reshape(f, f) / max(pooled["count"] - pooled["total"][0], 1)
    within = within + np.eye(f) * (1e-3 * np.trace(within) / f)
    means = classes.select("key", F.transform("total", lambda x: x / F.col("count")).alias("mean"))
    return Classifier(means, np.linalg.inv(np.linalg.cholesky(within)))


def classify(vectors: DataFrame, model: Classifier, column: str = "features", name: str = "prediction", keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """``vectors`` with the key of the nearest mean; ties go to the first key, a null vector has a null key.

    The means go to the tasks in blocks of ``keys_at_once``, each of which betters the nearest so far; a plan has at most
    eight blocks, then the rows are written.
    """
    found = vectors
    for nth, (keys, centres) in enumerate(model.blocks(keys_at_once)):
        if nth and nth % 8 == 0:
            found = written(found, "nearest")
        new = _nearest(vectors.sparkSession, keys, centres, model.whiten)(F.col(column).cast("array<double>"))
        if nth:
            found = found.withColumn(name, F.struct(F.col(name).alias("old"), new.alias("new")))
            new = F.when(F.col(name).new.distance < F.col(name).old.distance, F.col(name).new).otherwise(F.col(name).old)
        found = found.withColumn(name, new)
    return found.withColumn(name, F.col(name).key)


def _nearest(spark: SparkSession, keys: list[str], centres: np.ndarray, whiten: np.ndarray):
    shared = spark.sparkContext.broadcast((keys, centres, whiten))

    @F.pandas_udf("key string, distance double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        keys, centres, whiten = shared.value
        found = pd.DataFrame({"key": pd.Series([None] * len(x), dtype=object), "distance": pd.Series([None] * len(x), dtype="Float64")})
        there = np.flatnonzero(x.notna().to_numpy())
        for rows in np.array_split(there, range(1024, len(there), 1024)):  # rows by keys in memory
            if len(rows):
                turned = np.stack(x.iloc[rows].to_numpy()) @ whiten.T
                far = ((turned**2).sum(1)[:, None] - 2 * turned @ centres.T) + (centres**2).sum(1)
                best = far.argmin(1)
                found.iloc[rows, 0] = [keys[i] for i in best]
                found.iloc[rows, 1] = far[np.arange(len(rows)), best]
        return found

    return nearest


def mean_distances(totals: DataFrame, model: Classifier, features: int) -> DataFrame:
    """(kind, key, count, accent, distance): the mean squared distance of each group from each of the model's means, from
    totals alone; NaN for an empty group."""
    spark = totals.sparkSession
    return reduce(DataFrame.unionByName, [_distances(totals, spark.sparkContext.broadcast((*block, model.whiten)), features) for block in model.blocks()])


def _distances(totals: DataFrame, shared, features: int) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, centres, whiten = shared.value
        for pdf in batches:
            parts = []
            for kind, key, count, total, outer in zip(pdf["kind"], pdf["key"], pdf["count"], pdf["total"], pdf["outer"], strict=True):
                x, xx = whiten @ np.asarray(total), np.asarray(outer).reshape(features, features)
                far = (np.sum((whiten @ xx) * whiten) - 2 * centres @ x) / count + (centres**2).sum(1) if count else np.full(len(keys), np.nan)
                parts.append(pd.DataFrame({"kind": kind, "key": key, "count": count, "accent": keys, "distance": far}))
            if parts:
                yield pd.concat(parts)

    return totals.mapInPandas(measure, "kind string, key string, count long, accent string, distance double")


@dataclass(frozen=True)
class Projection:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray


def _folded(vectors: DataFrame, fold: Callable[[np.ndarray], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One matrix of all vectors (x array<double>, of one length): ``fold`` makes one of some rows, ``join`` one of several,
    in each task and then in two levels, so that no task holds more of them than the root of the number of tasks."""
    schema = "height int, cells array<double>"

    def batch(m: np.ndarray) -> pa.RecordBatch:
        cells = pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int32()), cells], ["height", "cells"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                made = fold(b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                state = made if state is None else join([state, made])
        if state is not None:
            yield batch(state)

    def joined(table: pa.Table) -> pa.Table:
        parts = [c.values.to_numpy().reshape(h.as_py(), -1) for h, c in zip(table["height"], table["cells"], strict=True)]
        return pa.Table.from_batches([batch(join(parts))])

    groups = max(1, round(vectors.sparkSession.sparkContext.defaultParallelism ** 0.5))
    some = vectors.mapInArrow(tasks, schema).groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")).applyInArrow(joined, schema)
    row = some.groupBy(F.lit("all")).applyInArrow(joined, schema).first()
    return None if row is None else np.array(row["cells"]).reshape(row["height"], -1)


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def fit_projection(vectors: DataFrame, dims: int, keep: int, column: str = "stats", passes: int = 4, seed: int = 7) -> Projection:
    """Standardisation and the first principal directions, by a randomised range finder; no dims by dims matrix is made.

    A random start of ``keep`` + 10 directions is widened ``passes`` - 1 times by what the data makes of its last part (a
    block Krylov space). The rows in that space are brought to a triangle by tall and skinny QR over tasks, whose singular
    vectors give the directions: exactly, where the space has all ``dims``, else about as exactly as the singular values
    fall off. Each direction's component of largest size (the first of equals) is positive, so that results compare.

    The vectors are read ``passes`` + 1 times; write them first where they are dear. Null vectors take no part; without
    any vector this is an error.
    """
    x = vectors.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))
    sums = _folded(x, lambda r: np.vstack([np.full(dims, float(len(r))), r.sum(0), (r * r).sum(0)]), sum)
    if sums is None:
        raise ValueError("no vectors to project")
    mean = sums[1] / sums[0]
    scale = np.sqrt(np.maximum(sums[2] / sums[0] - mean**2, 0)) + 1e-6
    standard = lambda r: (r - mean) / scale
    last = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(dims, keep + 10))))[0]
    space = last
    for _ in range(passes - 1):
        if space.shape[1] == dims:
            break
        wide = _folded(x, lambda r, last=last: standard(r).T @ (standard(r) @ last), sum)
        new = wide[:, : dims - space.shape[1]]
        for _ in range(2):  # twice, for rounding
            new = new - space @ (space.T @ new)
        last, size = np.linalg.qr(new)
        last = last[:, np.abs(np.diag(size)) > 1e-10 * max(np.abs(wide).max(), 1e-300)]
        if not last.shape[1]:
            break
        space = np.hstack([space, last])
    turned = np.linalg.svd(_folded(x, lambda r: _triangle([standard(r) @ space]), _triangle))[2]
    directions = space @ turned.T[:, :keep]
    largest = directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]
    return Projection(mean, scale, directions * np.where(largest < 0, -1, 1))


def project(vectors: DataFrame, projection: Projection, column: str = "stats", name: str = "features") -> DataFrame:
    """``vectors`` with their components along the projection's directions; null for a null vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(projection)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def turn(x: pd.Series) -> pd.Series:
        p = shared.value
        found = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna().to_numpy())
        if len(there):
            found.iloc[there] = list(((np.stack(x.iloc[there].to_numpy()) - p.mean) / p.scale) @ p.directions)
        return found

    return vectors.withColumn(name, turn(F.col(column).cast("array<double>")))


def place_report(native: DataFrame, contributors: DataFrame, min_contributors: int, min_takes: int) -> DataFrame:
    """One row for each native key: takes, contributors, enough_takes, enough_contributors, ready.

    People are known by country only: for regions and unknown countries they are null, and readiness then rests on takes.
    """
    country = F.substring_index("key", "-", 1)
    joined = native.withColumn("country", country).join(contributors, "country", "left").withColumn("people", F.when(~F.col("key").contains("-"), F.col("contributors")))
    enough = F.col("people") >= min_contributors
    return joined.select("key", F.col("count").alias("takes"), F.col("people").alias("contributors"), (F.col("count") >= min_takes).alias("enough_takes"), enough.alias("enough_contributors"), ((F.col("count") >= min_takes) & F.coalesce(enough, F.lit(True))).alias("ready"))


def tell_apart(native: DataFrame, report: DataFrame) -> list[str]:
    """Ready places that a classifier can be built of."""
    model = fit_classifier(native.join(report.filter("ready").select("key"), "key", "left_semi"))
    return [key for keys, _ in model.blocks() for key in keys] if model else []


def landing_report(groups: DataFrame, reference: DataFrame, features: int) -> DataFrame | None:
    """For each group its distance to each reference accent (2 digits), the closest, and whether that is its target; None
    for fewer than two references."""
    model = fit_classifier(reference)
    if model is None:
        return None
    far = mean_distances(groups, model, features).withColumn("distance", F.bround("distance", 2))
    target = F.when(F.col("key").contains(">"), F.substring_index("key", ">", -1))
    out = far.groupBy("key").agg(F.first("count").alias("takes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("accent", "distance")))).alias("distance_to"), F.min_by("accent", F.struct("distance", "accent")).alias("closest"))
    return out.select("key", "takes", F.when(target.isNotNull(), "attempt").otherwise("native").alias("kind"), target.alias("target"), "distance_to", "closest", F.when(F.map_contains_key("distance_to", F.coalesce(target, F.lit(""))), F.col("closest") == target).alias("lands_on_target"))


def reference_totals(windows: DataFrame, speakers: DataFrame, groups: dict[str, str], projection: Projection, features: int) -> DataFrame:
    """Totals of native speakers of each practice accent, from (speaker_id, stats) windows.

    ``groups``: practice accent -> the speakers' accent that stands for it.
    """
    names = F.create_map(*[x for accent, group in groups.items() for x in (F.lit(group), F.lit(accent))])
    placed = windows.join(speakers, "speaker_id").withColumn("key", names[F.col("accent")]).filter("key is not null")
    return totals_of(project(placed, projection).select(F.lit("reference").alias("kind"), "key", "features"), features)


def held_out_check(vectors: DataFrame, features: int, cap: int = 120) -> DataFrame:
    """(part, classes, balanced_accuracy) of a classifier made of totals alone.

    ``vectors``: speaker_id, accent, part ('window' or 'clip'), seq, features. Speakers of a class that are held out (every
    fourth) test it; of the others the first ``cap`` windows each are folded in.
    """
    split = splits(vectors.select("speaker_id", "accent").distinct()).select("speaker_id", (F.col("split") == "test").alias("test"))
    placed = vectors.join(split, "speaker_id")
    nth = F.row_number().over(Window.partitionBy("speaker_id").orderBy("seq"))
    train = placed.filter("not test and part = 'window'").withColumn("n", nth).filter(F.col("n") <= cap)
    model = fit_classifier(totals_of(train.select(F.lit("accent").alias("kind"), F.col("accent").alias("key"), "features"), features))
    if model is None:
        raise ValueError("at least two accents are needed")
    tested = classify(placed.filter("test"), model)
    recalls = tested.groupBy("part", "accent").agg(F.avg((F.col("accent") == F.col("prediction")).cast("int")).alias("recall"))
    return recalls.groupBy("part").agg(F.count("*").alias("classes"), F.avg("recall").alias("balanced_accuracy"))
