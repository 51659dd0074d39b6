"""URL filters by a temporal list join, in DataFrame and SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def url_keys(url: Column) -> Column:
    """What list entries can name of a URL, longest first: host and first path part, host, then each parent domain of
    two labels or more."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    part = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.isNotNull(), F.concat(F.array_compact(F.array(F.concat(host, F.lit("/"), part))), domains))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals in which a list names a pattern, from dated entries (list, pattern, action 'add' or 'remove', dated, seq).

    An entry holds from its date until the next entry of its list and pattern; of several on one date the one with the
    largest ``seq`` holds. Entries with a null in any of these columns do not count.
    """
    known = entries.dropna(subset=["list", "pattern", "action", "dated", "seq"])
    order = Window.partitionBy("list", "pattern").orderBy("dated", "seq")
    return known.withColumn("until", F.lead("dated").over(order)).filter("action = 'add' and (until is null or until > dated)").select("list", "pattern", F.col("dated").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, fetched_col: str, period: str = "month") -> DataFrame:
    """Join every capture to the list entries that were valid when it was fetched.

    As-of join by equality only: intervals are cut at the starts of periods and captures carry the period of their
    date, so a capture meets the few intervals of its pattern in its period, not the whole history. A pattern under
    which a large part of all captures falls is split by Spark's skew join, for the capture side is a plain sort-merge
    join input.

    Returns one row for each row of ``captures``: id, ``host``, fetched date, ``blocked``, and of the longest
    pattern that matches (ties: first list by name) ``pattern``, ``list`` and ``since``, and ``matches``, the number of
    entries valid at that time.

    Defined cases: a capture without URL, host or date is not blocked; a repeated id keeps its rows, told apart by URL
    and date, and exact repeats give equal rows; an empty list blocks nothing; further columns are ignored.
    """
    horizon = captures.agg(F.max(F.col(fetched_col).cast("date"))).first()[0]
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(fetched_col).cast("date").alias("fetched"))
    start = lambda d: F.trunc(d, period)
    last = F.least(F.coalesce(F.date_sub(F.col("until"), 1), F.lit(horizon)), F.lit(horizon))
    spans = validity(entries).filter(F.col("since") <= F.lit(horizon)).withColumn("period", F.explode(F.sequence(start(F.col("since")), start(last), F.expr(f"interval 1 {period}"))))
    keyed = base.select("id", "url", "fetched", start(F.col("fetched")).alias("period"), F.explode(url_keys(F.col("url"))).alias("pattern"))
    hits = keyed.join(spans, ["pattern", "period"]).filter("fetched >= since and (until is null or fetched < until)")
    best = F.min_by(F.struct("pattern", "list", "since"), F.struct((-F.char_length("pattern")).alias("l"), F.col("list")))
    found = hits.groupBy("id", "url", "fetched").agg(best.alias("best"), F.countDistinct("pattern", "list", "since").alias("matches"))
    same = F.col("b.id").eqNullSafe(F.col("f.id")) & F.col("b.url").eqNullSafe(F.col("f.url")) & F.col("b.fetched").eqNullSafe(F.col("f.fetched"))
    return base.alias("b").join(found.alias("f"), same, "left").select(
        F.col("b.id").alias(id_col), host_of(F.col("b.url")).alias("host"), F.col("b.fetched").alias("fetched"), F.col("best").isNotNull().alias("blocked"),
        F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"), F.col("best.since").alias("since"), F.coalesce("matches", F.lit(0)).alias("matches"),
    )
