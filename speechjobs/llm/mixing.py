"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechjobs.llm.common import row_key, word_count, written

#: A table of one row for each source is broadcast up to this many sources; beyond it, joins by source are salted.
BROADCAST_SOURCES = 50_000
#: Parts that a source is split into where its table cannot be broadcast.
SALTS = 32
#: Merits are told apart down to this part of a doubling, so that a source has few classes of merit.
MERIT_STEPS = 8
#: Rows that are equal in all and numbered by one task.
EQUAL_ROWS = 100_000


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with sums over all rows before each one, in an order of distinct values, without a window over the table.

    Rows are dealt by ranges; each range is summed on its own and moved by the sums of the ranges before it, of which
    there is one row for each task.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(*[F.sum(x).alias(f"__{k}") for k, x in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    joined = ranged.join(F.broadcast(moved), "__part")
    return joined.withColumns({k: F.col(f"__{k}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in sums.items()}).drop("__part", *[f"__{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of each source from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` times all sizes. A target
    stops at ``most`` times its source's size and what is over goes to the others by weight, until none is above. In
    closed form: sorted by limit / weight, the level of the first source whose limit is not reached holds for it and
    all after it. Any number of sources: orders are dealt by ranges.
    """
    turned = running_sums(sizes, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    weighted = turned.withColumns({"__w": weight, "__limit": F.col("source_size") * F.lit(float(most))}).withColumn("__ratio", F.col("__limit") / F.col("__w"))
    order = [F.col("__ratio"), F.col("source").asc_nulls_last()]
    summed = running_sums(weighted, order, {"__limits": F.col("__limit"), "__weights": F.col("__w")}, "sources")
    every = summed.agg(F.sum("source_size").alias("__all"), F.sum("__w").alias("__w_all"))  # one row
    leveled = summed.crossJoin(F.broadcast(every)).withColumn("__level", F.try_divide(F.col("__all") * F.lit(float(share)) - F.col("__limits"), F.col("__w_all") - F.col("__weights")))
    free = F.when(F.col("__level") * F.col("__w") <= F.col("__limit"), F.struct(F.col("__ratio").alias("ratio"), F.col("source").isNull().alias("last"), F.col("source").alias("source"), F.col("__level").alias("level")))
    first = leveled.agg(F.min(free)["level"].alias("__free"))  # one row
    return leveled.crossJoin(F.broadcast(first)).select("source", "source_size", F.coalesce(F.least(F.col("__limit"), F.col("__free") * F.col("__w")), F.col("__limit")).alias("target"))


def merit_of_length(text_col: str = "text") -> Column:
    """Longer documents are likelier to be taken, by the logarithm of their bytes."""
    return F.log2(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(2.0))


class Mix:
    """What was decided for each source, so that any row's copies follow from the row and its source's plan alone.

    ``plan``: one row for each source: source_size, target, level (copies expected for a merit of 1), and cut and last, which
    bound the ranks that are taken. Rows that are equal in id and text share a rank; where the cut is among them, ``take`` of
    the ``same`` rows of ``cut_key`` are taken.
    """

    def __init__(self, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, merit: Column | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.weights, self.share, self.most, self.seed, self.merit, self.size = weights, share, most, seed, merit, size
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col
        self.plan: DataFrame | None = None
        self.sources = self.buckets = 0
        self.split = False

    def facts(self, docs: DataFrame) -> dict[str, Column]:
        """Columns __size, __merit (a power of two to the nearest step; null for none), __key and __u of each row."""
        size = word_count(F.col(self.text_col)) if self.size is None else F.coalesce(self.size.cast("long"), F.lit(0).cast("long"))
        merit = F.lit(1.0) if self.merit is None else self.merit.cast("double")
        step = F.when(merit > 0, F.pow(F.lit(2.0), F.round(F.log2(merit) * MERIT_STEPS) / MERIT_STEPS))
        key = row_key(docs, self.id_col, self.text_col, F.xxhash64(F.col(self.text_col)))
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(self.seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return {"__size": size, "__merit": step, "__key": key, "__u": uniform}

    def with_plan(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """``rows`` (with __source and __key) joined to one row for each source."""
        right = plan.withColumnRenamed("source", "__named")
        same = rows["__source"].eqNullSafe(right["__named"])
        if self.sources <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(right), same, "left").drop("__named")
        left = rows.withColumn("__salt", F.pmod("__key", F.lit(SALTS)).cast("int"))
        right = right.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, same & (left["__salt"] == right["__salted"]), "left").drop("__named", "__salt", "__salted")

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Adds whole, rank and bucket: certain copies, and the place in the order of odds over inclusion odds, 0 to 1."""
        expected = F.least(F.lit(float(self.most)), F.coalesce(F.col("__merit") * F.col("level"), F.lit(0.0)))
        # a fraction next to 0 or 1 is a rounding error
        whole = F.floor(expected + 1e-9).cast("long")
        rest = rows.withColumns({"whole": whole, "__f": F.least(F.lit(1 - 1e-9), expected - whole)})
        odds = lambda p: p / (1 - p)
        ratio = odds(F.col("__u")) / odds(F.col("__f"))
        out = rest.withColumn("rank", F.when(F.col("__f") > 1e-9, ratio / (1 + ratio)))
        return out.withColumn("bucket", F.least(F.floor(F.col("rank") * self.buckets), F.lit(self.buckets - 1).cast("long")))

    def fit(self, docs: DataFrame, rows_per_task: int = 20_000) -> Mix:
        """Decide on targets, expected copies and cuts. Only sums by source, by class of merit and by bucket of ranks are
        shuffled, and the rows of the one bucket of each source in which its cut lies are sorted."""
        numbers = self.facts(docs)
        rows = written(docs.select(F.col(self.source_col).alias("__source"), *[v.alias(k) for k, v in numbers.items()]), "mix-rows")
        self.buckets = 64 + rows.count() // rows_per_task
        classes = written(rows.groupBy(F.col("__source").alias("source"), "__merit").agg(F.sum("__size").alias("words")), "mix-classes")
        sizes = written(classes.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sizes")
        self.sources = sizes.count()
        targets = written(source_targets(sizes, self.weights, self.share, self.most), "mix-targets")
        # the level of each source: classes of the highest merit reach the most copies first
        known = targets.withColumnRenamed("source", "__named")
        of_class = classes.filter("__merit is not null and words > 0").join(known, F.col("source").eqNullSafe(F.col("__named"))).drop("__named")
        falling = Window.partitionBy("source").orderBy(F.desc("__merit"))
        above, here = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
        level = (F.col("target") - self.most * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.sum(F.col("words") * F.col("__merit")).over(here)
        fits = of_class.withColumn("level", level).filter(F.col("level") * F.col("__merit") <= self.most)
        levels = fits.groupBy("source").agg(F.max_by("level", "__merit").alias("level")).withColumnRenamed("source", "__named")
        # where no class is left below the most copies, the target asks for all of them
        full = F.coalesce("level", F.when(F.col("target") > 0, F.lit(float(self.most) * 2.0**40)).otherwise(0.0))
        base = written(targets.join(levels, F.col("source").eqNullSafe(F.col("__named")), "left").select("source", "source_size", "target", full.alias("level")), "mix-levels")
        planned = self.ranked(self.with_plan(rows, base))

        sums = planned.groupBy("__source", "bucket").agg(F.sum("__size").alias("words"), F.sum(F.col("whole") * F.col("__size")).alias("sure"), F.max("target").alias("target"))
        whole_source = Window.partitionBy("__source")
        upto = whole_source.orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        need = sums.withColumns({"upto": F.sum("words").over(upto), "need": F.col("target") - F.sum("sure").over(whole_source)})
        at = F.struct("bucket", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))
        cut = need.filter("bucket is not null and upto >= need").groupBy(F.col("__source").alias("source")).agg(F.min_by(at, "bucket").alias("cut"))
        cut = written(base.join(cut.withColumnRenamed("source", "__named"), F.col("source").eqNullSafe(F.col("__named")), "left").drop("__named"), "mix-cuts")
        edge = self.ranked(self.with_plan(rows, cut)).filter("bucket = cut.bucket")
        before = Window.partitionBy("__source").orderBy("rank", "__key").rowsBetween(Window.unboundedPreceding, -1)
        one = edge.groupBy("__source", "rank", "__key").agg(F.count("*").alias("same"), F.max("__size").alias("each"), F.max("cut.need").alias("need"))
        one = one.withColumn("room", F.col("need") - F.coalesce(F.sum(F.col("same") * F.col("each")).over(before), F.lit(0)))
        # a row is taken if that comes closer to what is needed
        fit = F.when(F.col("each") > 0, F.floor(F.col("room") / F.col("each") + 0.5)).otherwise(F.when(F.col("room") >= 0, F.col("same")).otherwise(0))
        one = one.withColumn("take", F.greatest(F.lit(0), F.least(F.col("same"), fit.cast("long"))))
        part = F.when((F.col("take") > 0) & (F.col("take") < F.col("same")), F.struct("rank", F.col("__key").alias("cut_key"), "take", "same"))
        last = one.groupBy(F.col("__source").alias("__named")).agg(F.max(F.when(F.col("take") == F.col("same"), F.col("rank"))).alias("last"), F.min(part).alias("part"))
        joined = cut.join(last, F.col("source").eqNullSafe(F.col("__named")), "left")
        self.plan = written(joined.select("source", "source_size", "target", "level", F.col("cut.bucket").alias("cut"), "last", "part.cut_key", "part.take", "part.same"), "mix-plan")
        self.split = not self.plan.filter("take is not null").isEmpty()
        return self

    def copies(self, docs: DataFrame) -> DataFrame:
        """``docs`` with struct ``__mix`` (size, source_size, target, copies, key); no row is shuffled unless there are
        more sources than can be broadcast."""
        rows = docs.withColumns({"__source": F.col(self.source_col), **self.facts(docs)})
        chosen = self.ranked(self.with_plan(rows, self.plan))
        within = F.coalesce((F.col("bucket") == F.col("cut")) & (F.col("rank") <= F.col("last")), F.lit(False))
        if self.split:
            chosen = self._numbered(chosen)
            within |= F.col("__taken")
        extra = F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | within)
        count = F.least(F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(self.most).cast("long"))
        found = F.struct(F.col("__size").alias("size"), "source_size", "target", count.alias("copies"), F.col("__key").alias("key"))
        return chosen.withColumn("__mix", found).select(*(F.col(f"`{c}`") for c in docs.columns), "__mix")

    @staticmethod
    def _numbered(chosen: DataFrame) -> DataFrame:
        """Adds ``__taken``: of the equal rows among which a source's cut lies, as many as it says. They are numbered in parts of
        about EQUAL_ROWS, of which each gives its share."""
        at_cut = F.coalesce((F.col("__key") == F.col("cut_key")) & (F.col("bucket") == F.col("cut")), F.lit(False))
        spread = chosen.filter(at_cut).withColumn("__part", F.pmod(F.monotonically_increasing_id(), 1 + F.floor(F.col("same") / EQUAL_ROWS)))
        nth = F.row_number().over(Window.partitionBy("__source", "__key", "__part").orderBy(F.lit(0))).cast("long")
        share = lambda n: F.floor(n * F.col("take") / F.col("same"))
        equal = spread.withColumn("__nth", nth).withColumn("__taken", share(F.col("__nth")) > share(F.col("__nth") - 1))
        return chosen.filter(~at_cut).withColumn("__taken", F.lit(False)).unionByName(equal.drop("__part", "__nth"))


def _own(docs: DataFrame, mix: Mix) -> DataFrame:
    """The row as a struct beside the columns that the mix reads, so that no other column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *{c: F.col(f"`{c}`") for c in (mix.id_col, mix.text_col, mix.source_col)}.values())


def apply_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` as often as ``mix``, which was fitted to them, says."""
    chosen = mix.copies(_own(docs, mix)).filter("__mix.copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix.copies"))))
    return chosen.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
    size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", merit: Column | None = None, rows_per_task: int = 20_000,
) -> DataFrame:
    """Copies of each document so that every source's words come near its target.

    A document is to appear as often as its ``merit`` (all alike where that is not given) times the level of its source, at
    most ``most`` times; the level is such that the source's expected words are its target. The whole part of this is
    allocated for certain; for the rest, documents of a source are ranked by the odds of their random number over the
    odds of the fractional part, and the first ones are taken until their words reach what the source still needs, the
    last one only if that comes closer. Random numbers are hashes of the id and ``seed``: reruns agree.

    No task sees a whole source: ranks fall into buckets, bucket sums find the bucket in which the cut lies, and only
    that bucket's rows are sorted. ``merit`` and ``size`` are expressions over the id, the text and the source.

    Returns one row for each row of ``docs``: id, text's ``size``, ``source``, ``source_size``, ``target``, ``copies``,
    ``key`` (hash of the row's id, or of its text where there is none).

    Defined cases: null text has size 0; null source is a source; rows that repeat an id are taken each on its own;
    rows without an id are told apart by their text, and of rows that are equal in id and text as many are taken as fit; a merit that is null, 0 or below gives no copy unless its source needs
    all of its documents; sizes all 0 give targets 0; an empty table gives an empty table; further columns are
    ignored, whatever their names.
    """
    mix = Mix(weights, share, most, seed, merit, size, id_col, text_col, source_col)
    own = docs.select(*{c: F.col(f"`{c}`") for c in (id_col, text_col, source_col)}.values())
    chosen = mix.fit(own, rows_per_task).copies(own)
    return chosen.select(F.col(id_col), "__mix.size", F.col(source_col).alias("source"), "__mix.source_size", "__mix.target", "__mix.copies", "__mix.key")
