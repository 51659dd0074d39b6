"""Sharding by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechjobs.llm.common import row_key

#: A key jumps ln(shards) times on average. The same limit for every shard count keeps the law even if it is reached.
MOST_JUMPS = 128


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit key.

    A key walks through growing shard numbers: from ``b`` it jumps to ``floor((b + 1) / u)`` with the next uniform
    ``u`` of the key's own sequence, and stays at the last number below ``shards``. The sequence does not depend on
    ``shards``: with one more shard a key stays or moves to the new one. No ring or table is kept.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    n = F.lit(shards).cast("long")

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        to = F.floor((state["at"] + F.lit(1)).cast("double") * F.lit(2.0**31) / draw).cast("long")
        return F.when(state["at"] < n, F.struct(state["at"].alias("last"), to.alias("at"))).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step)["last"].cast("int")


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 10_000, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the shard with one shard more).

    Slots follow a hash order: each shard is cut into parts of about ``rows_per_task`` rows, numbered on their own and
    moved by the count of the parts before, so no task sees a whole shard.

    Defined cases: a null id is keyed by its text; rows with the same id share a shard and get slots of their own, in the
    order of the columns named in ``ties`` (rows equal in these too are told apart by nothing and may swap slots); a null
    text is allowed; an empty table gives an empty table; columns of the input that are called like the new ones are replaced,
    all others are kept, whatever their names and types.
    """
    new = ("shard", "slot", "grown_shard")
    parts = max(1, -(-df.count() // (shards * rows_per_task)))
    # the row as one column, so that its names cannot clash
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), row_key(df, id_col, text_col).alias("key"))
    keyed = keyed.withColumns({"shard": jump_shard(F.col("key"), shards), "grown_shard": jump_shard(F.col("key"), shards + 1), "part": F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int")})
    order = [F.col("row").getField(c) for c in (id_col, *ties)]
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", *order)).cast("long"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("shard", "part").agg(F.count("*").alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    joined = numbered.join(offsets, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("nth") - 1)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in new], *new)
