"""Ids that were counted once and must never be counted again: a store that grows by runs, with a filter for each part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechjobs.sources.runs import RunLog
from speechjobs.sources.shared import written

#: Bits for each id in a filter, and bits that an id sets: about one foreign id in a hundred passes.
BITS, PROBES = 10, 7


def _places(digests: list[str], bits: int) -> np.ndarray:
    """The bits of each digest, which is a hash already: two of its halves give all places."""
    one = np.array([int(d[-20:-10], 16) for d in digests], np.uint64)
    two = np.array([int(d[-10:], 16) | 1 for d in digests], np.uint64)
    return ((one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) % np.uint64(bits)).astype(np.int64)


def filter_of(digests: list[str]) -> bytes:
    """A Bloom filter of some digests."""
    bits = np.zeros(-(-BITS * max(len(digests), 1) // 8) * 8, bool)
    bits[_places(digests, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bloom: bytes, digests: list[str]) -> np.ndarray:
    """Whether each digest may be among those of the filter; never false for one that is."""
    bits = np.frombuffer(bloom, np.uint8)
    at = _places(digests, 8 * len(bits))
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


class SeenStore:
    """Digests (lower-case hexadecimal hashes of at least 20 digits) by run and, within a run, by their first digits.

    A run writes only what it adds: the digests of each part, and a filter of them. A look-up first asks the filters of the
    parts that it touches; only parts of which a filter answers yes are read, and only digests that may be there are
    joined. ``prefix`` digits give 16^prefix parts; a part of n digests has a filter of 10 n bits for each run, and
    compact() makes one of many runs.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: int = 2):
        self.spark, self.prefix = spark, prefix
        self.ids = RunLog(spark, f"{path}/ids", "digest string, part string")
        self.filters = RunLog(spark, f"{path}/filters", "part string, bloom binary")

    def _parted(self, digests: DataFrame) -> DataFrame:
        return digests.select("digest", F.substring("digest", 1, self.prefix).alias("part")).filter("digest is not null").distinct()

    def maybe(self, digests: DataFrame, before: int | None = None) -> DataFrame:
        """(digest, part) of those that a filter of runs before ``before`` lets pass."""

        def test(asked: pa.Table, filters: pa.Table) -> pa.Table:
            if not asked.num_rows or not filters.num_rows:
                return asked.slice(0, 0)
            names = asked["digest"].to_pylist()
            passed = np.zeros(len(names), bool)
            for bloom in filters["bloom"].to_pylist():
                passed |= may_hold(bloom, names)
            return asked.filter(pa.array(passed))

        # a part with many new ids is asked in pieces
        pieces = F.explode(F.sequence(F.lit(0), F.lit(15)))
        asked = self._parted(digests).withColumn("piece", F.pmod(F.xxhash64("digest"), F.lit(16)).cast("int"))
        filters = self.filters.read(before).withColumn("piece", pieces)
        return asked.groupBy("part", "piece").cogroup(filters.groupBy("part", "piece")).applyInArrow(test, "digest string, part string, piece int").select("digest", "part")

    def known(self, digests: DataFrame, before: int | None = None) -> DataFrame:
        """(digest) of those that runs before ``before`` stored, exactly."""
        if not self.ids.folders(before):
            return self.spark.createDataFrame([], "digest string")
        asked = written(self.maybe(digests, before), "maybe-seen")
        # as many values as there are parts, whatever the store holds
        parts = sorted(r["part"] for r in asked.select("part").distinct().collect())
        stored = self.ids.read(before).filter(F.col("part").isin(parts))
        return asked.join(stored, ["part", "digest"], "left_semi").select("digest")

    def add(self, digests: DataFrame, run: int, last: int | None = None) -> None:
        """Store the digests that a run adds. The same run again replaces itself."""
        new = written(self._parted(digests), "new-seen")

        def build(table: pa.Table) -> pa.Table:
            return pa.table({"part": [table["part"][0].as_py()], "bloom": pa.array([filter_of(table["digest"].to_pylist())], pa.binary())})

        # filters first: ids without one would not be found, a filter without ids only costs a look
        self.filters.write(new.groupBy("part").applyInArrow(build, "part string, bloom binary"), run, last)
        self.ids.write(new.repartition("part"), run, last, by=("part",))

    def compact(self) -> None:
        """Make one run of all."""
        runs = self.ids.folders()
        if len(runs) > 1:
            self.add(self.ids.read().select("digest"), min(runs)[0], max(r[1] for r in runs))
            self.ids.drop_replaced()
            self.filters.drop_replaced()
