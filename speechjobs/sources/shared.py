"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only for a local master: the disks of
    a cluster's machines are not shared, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="speechjobs-"))
    return context.getCheckpointDir()


def _scratch(context: SparkContext) -> str:
    return f"{context.getCheckpointDir()}/speechjobs-{context.applicationId}"


def _delete(context: SparkContext, path: str) -> None:
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, and that goes with what written() wrote."""
    shared_folder(spark)
    return f"{_scratch(spark.sparkContext)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The written files survive the loss of executors, so later jobs never go back further than this. They are deleted by
    release(), by discard() and when the driver ends.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() gave and that no later job reads."""
    context = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if f"/speechjobs-{context.applicationId}/" in path:
            _delete(context, path)


def release(spark: SparkSession) -> None:
    """Delete all that written() wrote in this application; results that still read it must be saved before."""
    if spark.sparkContext.getCheckpointDir() is not None:
        _delete(spark.sparkContext, _scratch(spark.sparkContext))


@atexit.register
def _release_at_exit() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None and context.getCheckpointDir() is not None:
        _delete(context, _scratch(context))
