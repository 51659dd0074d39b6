"""Ingest of validated takes: each id once, caps, routes, totals, summaries; rebuild and dry run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechjobs import constants as K
from speechjobs.functions.gates import route
from speechjobs.operators.totals import SCHEMA, load_totals, merge_totals, partial_totals, save_totals
from speechjobs.sources.runs import RunLog
from speechjobs.sources.seen import SeenStore
from speechjobs.sources.shared import discard, written

ADDED, DUPLICATE, OVER_CAP, REFUSED = "added", "duplicate", "over_cap", "refused"


def digest(take_id):
    """What is remembered of a take's id."""
    return F.substring(F.sha2(F.lower(take_id), 256), 1, 24)


def judge(checked: DataFrame, seen: DataFrame | Callable[[DataFrame], DataFrame], cap: int = K.MAX_TAKES_PER_CONTRIBUTOR) -> DataFrame:
    """``checked`` with ``digest`` and ``status``: refused, duplicate, over_cap or added. ``seen``: the digests counted before, or
    what gives of some digests those that were.

    As when takes are walked one by one in the order of path and position: a valid take whose id was counted before is a
    duplicate; the first of an id counts, unless its contributor already has ``cap`` takes; an id that was over the cap
    is not remembered, so a repeat of it by the same contributor is over the cap again.

    Each contributor's first take of an id is a candidate. Where no id is shared by contributors a candidate counts if it is
    among its contributor's first ``cap``. Else the order matters, and settle_candidates() decides in rounds. Either way a
    take is then the one that counted, later than it (duplicate) or earlier (over the cap).
    """
    own_names = [*checked.columns, "digest", "status"]
    valid = F.col("reason").isNull()
    # parsing and checking is the dear part and several passes follow: it is done once
    named = written(checked.withColumn("digest", F.when(valid, digest(F.col("id")))), "checked")
    order = F.struct("path", "pos")
    before = seen(named.filter("digest is not null").select("digest")) if callable(seen) else seen
    known = before.select(F.col("digest").alias("__seen")).distinct()
    marked = named.join(known, F.col("digest") == F.col("__seen"), "left")
    firsts = marked.filter("reason is null and __seen is null").groupBy("digest", "contributor").agg(F.min(order).alias("at"))
    several = firsts.groupBy("digest").agg(F.count("*").alias("people")).agg(F.max("people")).first()[0] or 0
    if several > 1:
        counted = settle_candidates(firsts, cap)
    else:
        counted = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("contributor").orderBy("at"))).filter(F.col("nth") <= cap).select("digest", "at")
    counted = counted.select(F.col("digest").alias("__digest"), F.col("at").alias("__at"))
    status = (
        F.when(~valid, REFUSED).when(F.col("__seen").isNotNull() | F.coalesce(order > F.col("__at"), F.lit(False)), DUPLICATE)
        .when(order == F.col("__at"), ADDED).otherwise(OVER_CAP)
    )
    return marked.join(counted, F.col("digest") == F.col("__digest"), "left").withColumn("status", status).select(own_names)


def settle_candidates(firsts: DataFrame, cap: int) -> DataFrame:
    """(digest, at): the candidate of each digest that counts, from (digest, contributor, at), exactly as in a walk by ``at``.

    Rounds of windows over the open candidates. With the candidates before it of the same digest and of the same
    contributor, one is out if its digest is taken or if ``cap`` takes surely count before it, and counts if no earlier one
    of its digest is open and fewer than ``cap`` of its contributor's count or are open. Every round decides at least the
    earliest open candidate, and all that hang on no open one; the state is written between rounds.
    """
    same, mine = (Window.partitionBy(k).orderBy("at").rowsBetween(Window.unboundedPreceding, -1) for k in ("digest", "contributor"))
    open_, won = F.col("counts").isNull(), F.coalesce("counts", F.lit(False))
    before = lambda test, window: F.coalesce(F.sum(test.cast("long")).over(window), F.lit(0))
    state = written(firsts.select("digest", "contributor", "at", F.lit(None).cast("boolean").alias("counts")), "candidates")
    counted = []
    while True:
        near = state.select("*", before(won, same).alias("taken"), before(open_, same).alias("rivals"), before(won, mine).alias("least"), before(open_, mine).alias("more"))
        out = (F.col("taken") > 0) | (F.col("least") >= cap)
        fate = F.when(out, False).when((F.col("rivals") == 0) & (F.col("least") + F.col("more") < cap), True)
        judged = written(near.select("digest", "contributor", "at", F.coalesce("counts", fate).alias("counts")), "candidates")
        discard(state)
        counted.append(judged.filter("counts").select("digest", "at"))
        left = judged.filter("counts is null")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, counted).distinct()
        # what the open ones depend on: all candidates of their digests and contributors
        digests, people = left.select("digest").distinct(), left.select("contributor").distinct()
        keep = judged.join(digests.withColumn("__d", F.lit(True)), "digest", "left").join(people.withColumn("__c", F.lit(True)), "contributor", "left")
        state = written(keep.filter("__d or __c").select(*state.columns), "candidates")


def routed(judged: DataFrame) -> DataFrame:
    """(kind, key, country, contributor, features): added takes, once for each totals key they join."""
    added = judged.filter(F.col("status") == ADDED).withColumn("route", route(F.col("country"), F.col("region"), F.col("target_accent"), F.col("natural_voice")))
    return added.select(F.col("route.kind").alias("kind"), F.explode("route.keys").alias("key"), "country", "contributor", "features")


def status_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("status", "reason").agg(F.count("*").alias("takes"))


def added_counts(routes: DataFrame) -> DataFrame:
    return routes.groupBy("kind", "key").agg(F.count("*").alias("added"))


def country_summary(totals: DataFrame, added: DataFrame, judged: DataFrame, min_contributors: int = K.MIN_CONTRIBUTORS, min_takes: int = K.MIN_TAKES) -> DataFrame:
    """One row for each country of either store: native_total, native_added, regions and attempts (maps of total and
    added), contributors of this run, ready."""
    both = totals.select("kind", "key", F.col("count").alias("total")).join(added, ["kind", "key"], "full").select("kind", "key", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("added", F.lit(0)).alias("added"))
    part = lambda sep: F.element_at(F.split("key", sep), -1)
    placed = both.withColumns({"country": F.regexp_extract("key", "^[^->]+", 0), "part": F.when(F.col("key").contains("-"), part("-")).when(F.col("key").contains(">"), part(">"))})
    native, whole = F.col("kind") == "native", F.col("part").isNull()
    counts = F.struct("total", "added")
    mapped = lambda test: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, F.struct("part", counts.alias("counts"))))))
    each = placed.groupBy("country").agg(
        F.coalesce(F.sum(F.when(native & whole, F.col("total"))), F.lit(0)).alias("native_total"), F.coalesce(F.sum(F.when(native & whole, F.col("added"))), F.lit(0)).alias("native_added"),
        mapped(native & ~whole).alias("regions"), mapped(~native).alias("attempts"),
    )
    people = judged.filter(F.col("status") == ADDED).groupBy("country").agg(F.countDistinct("contributor").alias("contributors_this_run"))
    out = each.join(people, "country", "left").withColumn("contributors_this_run", F.coalesce("contributors_this_run", F.lit(0)))
    return out.withColumn("ready", (F.col("native_total") >= min_takes) & (F.col("contributors_this_run") >= min_contributors))


@dataclass
class Run:
    """What one ingest did; every part is a DataFrame."""

    judged: DataFrame
    skipped: DataFrame
    totals: DataFrame
    added: DataFrame
    countries: DataFrame


def seen_store(spark: SparkSession, store: str, version: int, fresh: bool) -> SeenStore:
    """The digests that ``version`` and its forebears counted, back to the last rebuild; a new store for a new start."""
    starts = sorted(int(p.rsplit("=", 1)[1]) for p in RunLog(spark, store, "digest string").names("seen/from=*"))
    start = version + 1 if fresh else max((s for s in starts if s <= version), default=version + 1)
    return SeenStore(spark, f"{store}/seen/from={start}")


def ingest(spark: SparkSession, checked: DataFrame, skipped: DataFrame, store: str, feature_set: str, features: int, version: int, dry_run: bool = False, rebuild: bool = False, cap: int = K.MAX_TAKES_PER_CONTRIBUTOR) -> Run:
    """Fold all new, valid takes into the store of the next version.

    The store is a folder of versions of totals and of seen digests by run; ``version`` is the one to read (0: none), and
    version + 1 is written, so nothing is read and written at once. Of the digests only those that this run adds are
    written, and only the parts that may hold one of its takes are read. ``rebuild`` ignores what is stored: the result is
    exactly the given files. ``dry_run`` writes nothing.
    """
    fresh = rebuild or version == 0
    seen = seen_store(spark, store, version, fresh)
    judged = judge(checked, (lambda digests: seen.known(digests, version + 1)), cap)
    routes = routed(judged)
    parts = [partial_totals(routes, features)] + ([] if fresh else [load_totals(spark, f"{store}/v{version}/totals", feature_set)])
    totals = merge_totals(*parts)
    if not dry_run:
        save_totals(totals, f"{store}/v{version + 1}/totals", feature_set)
        judged = written(judged, "judged")
        routes = routed(judged)
        seen.add(judged.filter(F.col("status") == ADDED).select("digest"), version + 1)
        totals = spark.read.schema(f"{SCHEMA}, feature_set string").parquet(f"{store}/v{version + 1}/totals").drop("feature_set")
    added = added_counts(routes)
    return Run(judged, skipped, totals, added, country_summary(totals, added, judged))


def ingest_summary(run: Run, feature_set: str, dry_run: bool = False, rebuilt: bool = False) -> DataFrame:
    """One row of nested figures for a report file."""
    j = run.judged
    count = lambda s: F.count_if(F.col("status") == s)
    takes = j.agg(count(ADDED).alias("added"), count(DUPLICATE).alias("duplicates"), count(OVER_CAP).alias("over_contributor_cap"))
    named = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias("m"))
    refused = named(j.filter(F.col("status") == REFUSED), "reason").select(F.col("m").alias("refused"))
    skipped = named(run.skipped, "reason").select(F.col("m").alias("files_skipped"))
    kinds = run.added.agg(F.coalesce(F.sum(F.when((F.col("kind") == "native") & ~F.col("key").contains("-"), F.col("added"))), F.lit(0)).alias("added_native"), F.coalesce(F.sum(F.when(F.col("kind") == "attempt", F.col("added"))), F.lit(0)).alias("added_attempts"))
    by_name = lambda a, b: F.when(a["country"] < b["country"], -1).otherwise(1)
    countries = run.countries.agg(F.array_sort(F.collect_list(F.struct(*run.countries.columns)), by_name).alias("countries"))
    head = takes.select(F.lit(feature_set).alias("feature_set"), F.lit(dry_run).alias("dry_run"), F.lit(rebuilt).alias("rebuilt"), "*")
    # every part is a single row
    return head.crossJoin(kinds).crossJoin(refused).crossJoin(skipped).crossJoin(countries)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)
