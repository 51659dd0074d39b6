"""Streams of export files and attempts. Each job has a batch twin that it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechjobs import constants as K
from speechjobs.functions.gates import route
from speechjobs.operators.ingest import digest
from speechjobs.operators.totals import TotalsLog, totals_of
from speechjobs.sources.exports import check_takes, parse_files
from speechjobs.sources.seen import SeenStore
from speechjobs.sources.shared import written


def takes_stream(spark: SparkSession, folder: str, app: str, feature_set: str, features: int = K.FEATURES, names: str = "*.json") -> DataFrame:
    """Validated, routed takes of export files as they arrive; the same column functions as in batch."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    takes, _ = parse_files(files.select(F.col("_metadata.file_path").alias("path"), "value"), app)
    checked = check_takes(takes, feature_set, features)
    where = F.when(F.col("reason").isNull(), route(F.col("country"), F.col("region"), F.col("target_accent"), F.col("natural_voice")))
    return checked.withColumns({"route": where, "digest": digest(F.col("id"))})


def once_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Each id once within the watermark: bounded state, for feeds whose repeats come soon."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def once_forever(batch: DataFrame, seen: DataFrame | SeenStore, number: int | None = None) -> DataFrame:
    """Each id once, ever: the first of the batch, unless it is in ``seen``, or a batch before ``number`` put it there.
    Exact; of a store only the parts are read whose filters let an id of the batch pass."""
    first = batch.groupBy("digest").agg(F.min(F.struct("path", "pos")).alias("f")).select("digest", F.col("f.path").alias("path"), F.col("f.pos").alias("pos"))
    known = seen if isinstance(seen, DataFrame) else seen.known(first.select("digest"), number)
    return batch.join(first, ["digest", "path", "pos"], "left_semi").join(known, "digest", "left_anti")


def capped(stream: DataFrame, cap: int = K.MAX_TAKES_PER_CONTRIBUTOR) -> DataFrame:
    """The first ``cap`` takes of each contributor over the whole query: (contributor, digest). State: one count each."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for pdf in batches:
            taken = pdf.head(max(0, cap - used))
            used += len(taken)
            yield taken[["contributor", "digest"]]
        state.update((used,))

    return stream.select("contributor", "digest").groupBy("contributor").applyInPandasWithState(keep, "contributor string, digest string", "used int", "append", GroupStateTimeout.NoTimeout)


class _Streak(StatefulProcessor):
    """Attempts in a row at or above the pass score, for each learner; a learner who stays away for ``keep_ms`` is forgotten."""

    def __init__(self, pass_score: float, keep_ms: int | None):
        self.pass_score, self.keep_ms = pass_score, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "streak int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("id")
        streak = self.state.get()[0] if self.state.exists() else 0
        out = []
        for score in pdf["score"]:
            streak = streak + 1 if score >= self.pass_score else 0
            out.append(streak)
        self.state.update((streak,))
        yield pd.DataFrame({"user_id": key[0], "id": pdf["id"].to_numpy(), "streak": out})

    def close(self) -> None:
        pass


def streak_stream(attempts: DataFrame, pass_score: float = 8.0, keep_ms: int | None = None) -> DataFrame:
    """(user_id, id, streak) of each attempt as it arrives. Needs the RocksDB state store. With ``keep_ms`` the streak of a
    learner who left is dropped from the state after that time, and begins again at 0; such a stream has timers without end, so it needs a trigger other than availableNow."""
    mode = "None" if keep_ms is None else "ProcessingTime"
    return attempts.select("user_id", "id", "score").groupBy("user_id").transformWithStateInPandas(_Streak(pass_score, keep_ms), "user_id long, id long, streak int", "Append", mode)


DAY_MS = 86_400_000
#: Stands for the day of rows without a time: it is over before any watermark, so they are handed on at once.
NO_DAY = -1_000_000_000


def _summed(users: list[np.ndarray], attempts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each user once, in order, with all of its attempts."""
    found, place = np.unique(np.concatenate(users), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(attempts))
    return found, total


class _Days(StatefulProcessor):
    """Attempts by learner of one bucket of learners and day of UTC: a day's counts when the watermark has passed its end, and
    late rows by themselves. State: two arrays for each bucket and open day, so the calls to the state do not grow with the
    learners."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "users binary, attempts binary")

    def _stored(self) -> tuple[np.ndarray, np.ndarray]:
        users, attempts = self.counts.get()
        return np.frombuffer(users, np.int64), np.frombuffer(attempts, np.int64)

    def _rows(self, key, users: np.ndarray, attempts: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"bucket": key[0], "user": users, "day": key[1], "attempts": attempts, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users, attempts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in rows:
            users, attempts = _summed([users, pdf["user"].to_numpy(np.int64)], [attempts, np.ones(len(pdf), np.int64)])
        if (key[1] + 1) * DAY_MS <= timerValues.getCurrentWatermarkInMs():
            yield self._rows(key, users, attempts, True)
            return
        if self.counts.exists():
            stored = self._stored()
            users, attempts = _summed([stored[0], users], [stored[1], attempts])
        else:
            self.handle.registerTimer((key[1] + 1) * DAY_MS)
        self.counts.update((users.tobytes(), attempts.tobytes()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, *self._stored(), False)
        self.counts.clear()

    def close(self) -> None:
        pass


def day_stream(attempts: DataFrame, delay: str = "2 days", buckets: int = 128) -> DataFrame:
    """(user_id, day, attempts, late): each day of a learner once, when the watermark has passed its end, and for rows that
    come later than that a correction, marked late, in place of dropping them: the sum over a day is the whole count. State:
    open days only, one value for each of ``buckets`` parts of the learners; their number stays as it is while a stream lives.
    Needs the RocksDB state store."""
    real = attempts.filter(F.col("source") == "real").withWatermark("timestamp", delay)
    user = F.col("user_id").cast("long")
    # without the watermarked column itself Spark hands late rows over; learners without an id have a bucket of their own
    rows = real.select(F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(buckets))).alias("bucket"), F.coalesce(F.floor(F.unix_millis("timestamp") / DAY_MS), F.lit(NO_DAY)).alias("day"), F.coalesce(user, F.lit(0)).alias("user"))
    found = rows.groupBy("bucket", "day").transformWithStateInPandas(_Days(), "bucket long, user long, day long, attempts long, late boolean", "Append", "EventTime")
    return found.select(F.when(F.col("bucket") >= 0, F.col("user")).alias("user_id"), F.when(F.col("day") > NO_DAY, F.date_from_unix_date(F.col("day").cast("int"))).alias("day"), "attempts", "late")


def streak_feed(attempts: DataFrame, pass_score: float = 8.0) -> DataFrame:
    """The same by applyInPandasWithState, which any state store serves."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("id")
        streak = state.get[0] if state.exists else 0
        out = []
        for score in pdf["score"]:
            streak = streak + 1 if score >= pass_score else 0
            out.append(streak)
        state.update((streak,))
        yield pd.DataFrame({"user_id": key[0], "id": pdf["id"].to_numpy(), "streak": out})

    return attempts.select("user_id", "id", "score").groupBy("user_id").applyInPandasWithState(follow, "user_id long, id long, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def daily_stream(attempts: DataFrame, delay: str = "2 days") -> DataFrame:
    """Attempts of each learner and day. Rows later than the watermark are dropped; the batch count has them all."""
    days = attempts.filter(F.col("source") == "real").withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day"), "user_id").count()
    return days.select(F.to_date("window.start").alias("day"), "user_id", F.col("count").alias("attempts"))


def fold_batches(store: str, feature_set: str, features: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch of (kind, key, features) to a log of totals, exactly once.

    Batch n stores its own totals as run n of a TotalsLog, and no other batch's; replayed, it stores the same run again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        TotalsLog(batch.sparkSession, store, feature_set).add(totals_of(batch, features), number)

    return fold


def fold_takes(store: str, feature_set: str, features: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for takes_stream(): each valid id counts once over all batches, and the totals of its
    route's keys grow by it. A batch that is replayed finds what batches before it stored, and replaces its own."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = SeenStore(spark, f"{store}/seen")
        # judged once: a filter before the write would have every take's rules worked out a second time
        judged = written(batch.select("path", "pos", "reason", "digest", "route", "features"), "batch")
        new = written(once_forever(judged.filter("reason is null").drop("reason"), seen, number), "new-takes")
        routes = new.select(F.col("route.kind").alias("kind"), F.explode("route.keys").alias("key"), "features")
        # the ids last: a batch that breaks off before them is folded again as a whole
        TotalsLog(spark, f"{store}/totals", feature_set).add(totals_of(routes, features), number)
        seen.add(new.select("digest"), number)

    return fold
