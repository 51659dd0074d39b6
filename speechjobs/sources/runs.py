"""Tables that grow by runs: each run adds a folder of its own, and nothing that is stored is written again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class RunLog:
    """A folder of runs. A run is there once its folder has the file that Spark writes last, so a run that broke off
    counts for nothing, and one that is repeated takes the place of itself: every run counts exactly once.

    compact() writes the runs up to one again as a single folder, which stands for them from then on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self, pattern: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, [f.getPath() for f in files.globStatus(at) or []]

    def names(self, pattern: str) -> list[str]:
        """Names of the files and folders that match."""
        return [p.getName() for p in self._files(pattern)[1]]

    def folders(self, before: int | None = None) -> dict[tuple[int, int], str]:
        """Folder of each stored range of runs (first, last), without those that a larger range stands for."""
        found = {}
        for p in self._files("run=*/_SUCCESS")[1]:
            name = p.getParent().getName()
            first, last = re.fullmatch(r"run=(\d+)-(\d+)", name).groups()
            found[int(first), int(last)] = f"{self.path}/{name}"
        found = {r: f for r, f in found.items() if before is None or r[1] < before}
        inside = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
        return {r: f for r, f in sorted(found.items()) if not any(inside(r, other) for other in found)}

    def read(self, before: int | None = None, under: str = "") -> DataFrame:
        """All that runs before ``before`` (or all runs) added; of a folder ``under`` each run's, if given."""
        paths = [f"{f}{under}" for f in self.folders(before).values()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # a path each, so that columns that folders are named after are kept and the runs are not
        tables = [self.spark.read.option("basePath", p).schema(self.schema).parquet(p) for p in paths]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def write(self, df: DataFrame, first: int, last: int | None = None, by: tuple[str, ...] = ()) -> None:
        """Store what a run adds, in place of what an earlier attempt at it stored."""
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/run={first:09d}-{first if last is None else last:09d}")

    def last(self) -> int | None:
        return max((r[1] for r in self.folders()), default=None)

    def drop_replaced(self) -> None:
        """Delete folders of runs that a compacted one stands for."""
        files, found = self._files("run=*")
        kept = {f.rsplit("/", 1)[1] for f in self.folders().values()}
        ranges = [tuple(map(int, re.fullmatch(r"run=(\d+)-(\d+)", n).groups())) for n in kept]
        for p in found:
            first, last = map(int, re.fullmatch(r"run=(\d+)-(\d+)", p.getName()).groups())
            if p.getName() not in kept and any(a <= first and last <= b for a, b in ranges):
                files.delete(p, True)
