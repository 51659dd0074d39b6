"""Minimum-edit alignment of phoneme sequences, and measures made of its operations."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechjobs import constants as K
from speechjobs.functions.symbols import among, same_class, strip_all
from speechjobs.sources.shared import written

OPS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref_index", T.IntegerType()), T.StructField("hyp_index", T.IntegerType())]))
ALIGNMENT = T.StructType([T.StructField("ops", OPS), *[T.StructField(n, T.IntegerType()) for n in ("hits", "substitutions", "deletions", "insertions")]])


def _align_all(refs: np.ndarray, hyps: np.ndarray) -> list[list[tuple]]:
    """Operations of pairs that all have the same two lengths; refs and hyps hold one coded sequence in each row.

    All pairs fill their cost tables together, and walk back together: diagonal before deletion before insertion.
    """
    count, n = refs.shape
    m = hyps.shape[1]
    cost = np.zeros((n + 1, m + 1, count), np.int32)
    cost[:, 0], cost[0, :] = np.arange(n + 1)[:, None], np.arange(m + 1)[:, None]
    differs = refs.T[:, None] != hyps.T[None]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1, cost[i - 1, j - 1] + differs[i - 1, j - 1])
    i, j, pair = np.full(count, n), np.full(count, m), np.arange(count)
    ops: list[list[tuple]] = [[] for _ in range(count)]
    while (going := np.flatnonzero((i > 0) | (j > 0))).size:
        a, b = i[going], j[going]
        here = cost[a, b, going]
        up, left = np.maximum(a - 1, 0), np.maximum(b - 1, 0)
        other = differs[up, left, going] if n and m else np.zeros(len(going), bool)
        across = (a > 0) & (b > 0) & (here == cost[up, left, going] + other)
        down = ~across & (a > 0) & (here == cost[up, b, going] + 1)
        for p, x, y, ac, ot, dn in zip(pair[going].tolist(), a.tolist(), b.tolist(), across.tolist(), other.tolist(), down.tolist(), strict=True):
            ops[p].append(("substitute" if ot else "equal", x - 1, y - 1) if ac else ("delete", x - 1, None) if dn else ("insert", None, y - 1))
        i[going], j[going] = a - (across | down), b - (across | ~down)
    return [o[::-1] for o in ops]


@F.pandas_udf(ALIGNMENT)
def align_ops(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Alignment of each pair; equal pairs of a batch are worked out once, pairs of the same lengths together."""
    keys = [(tuple(r), tuple(h)) if r is not None and h is not None else None for r, h in zip(ref, hyp, strict=True)]
    codes: dict[str, int] = {}
    by_size: dict[tuple[int, int], list] = {}
    for k in dict.fromkeys(k for k in keys if k is not None):
        by_size.setdefault((len(k[0]), len(k[1])), []).append(k)
    done: dict[tuple, dict] = {}
    for (n, m), pairs in by_size.items():
        coded = [np.array([[codes.setdefault(s, len(codes)) for s in p[side]] for p in pairs], np.int32).reshape(len(pairs), size) for side, size in ((0, n), (1, m))]
        for k, ops in zip(pairs, _align_all(*coded), strict=True):
            kinds = [o[0] for o in ops]
            done[k] = {"ops": [dict(zip(("kind", "ref_index", "hyp_index"), o, strict=True)) for o in ops], "hits": kinds.count("equal"), "substitutions": kinds.count("substitute"), "deletions": kinds.count("delete"), "insertions": kinds.count("insert")}
    empty = dict.fromkeys(ALIGNMENT.names)
    return pd.DataFrame([done[k] if k is not None else empty for k in keys], columns=ALIGNMENT.names)


#: Distinct pairs that are sent to all tasks; more of them are joined by a hash and a salt.
PAIRS_SENT, SALTS = 50_000, 16


def once_per_pair(df: DataFrame, ref: str, hyp: str, compute: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``df`` with a column ``name`` that depends on two sequence columns alone, worked out once for each distinct pair.

    ``compute`` adds ``name`` to a table of (ref, hyp). Practice material repeats: the dictionary of pairs is written, and
    joined back. Up to PAIRS_SENT pairs go to all tasks, so that no row of ``df`` is shuffled; more are joined by
    their hash, with a salt, for one pair may have most of the rows.
    """
    pairs = written(compute(df.select(F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).distinct()).select("ref", "hyp", name), "pairs")
    key = lambda r, h: F.xxhash64(r, h)
    held = pairs.select(key("ref", "hyp").alias("__k2"), F.col("ref").alias("__r2"), F.col("hyp").alias("__h2"), name)
    keyed = df.withColumn("__k", key(F.col(ref), F.col(hyp)))
    same = (F.col("__k") == F.col("__k2")) & F.col(ref).eqNullSafe(F.col("__r2")) & F.col(hyp).eqNullSafe(F.col("__h2"))
    if pairs.count() <= PAIRS_SENT:
        return keyed.join(F.broadcast(held), same, "left").select(*df.columns, name)
    keyed = keyed.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salted = held.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(salted, same & (F.col("__salt") == F.col("__salted")), "left").select(*df.columns, name)


def with_alignment(df: DataFrame, ref: str, hyp: str, name: str = "alignment", stress: bool = False) -> DataFrame:
    """``df`` with the alignment of two phoneme columns, stress ignored unless asked for.

    Distinct pairs are aligned once. Null sequences give a null alignment.
    """
    bare = (lambda c: c) if stress else strip_all
    return once_per_pair(df, ref, hyp, lambda pairs: pairs.withColumn(name, align_ops(bare(F.col("ref")), bare(F.col("hyp")))), name)


def counted_pairs(df: DataFrame, keys: tuple[str, ...], ref: str, hyp: str) -> DataFrame:
    """(keys, ref, hyp, n, alignment): how often each pair comes, combined before it is shuffled, and aligned once."""
    counts = df.groupBy(*keys, F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).agg(F.count("*").alias("n"))
    return counts.withColumn("alignment", align_ops(strip_all(F.col("ref")), strip_all(F.col("hyp"))))


def exact_share(ops: Column, target: Column) -> Column:
    """Percent of target sounds heard as written; 0 for an empty target."""
    return F.coalesce(F.try_divide(100.0 * F.size(F.filter(ops, lambda o: o["kind"] == "equal")), F.size(target)), F.lit(0.0))


def any_sound_share(ops: Column, target: Column) -> Column:
    """Percent of target sounds for which something was heard."""
    return F.coalesce(F.try_divide(100.0 * F.size(F.filter(ops, lambda o: o["kind"].isin("equal", "substitute"))), F.size(target)), F.lit(0.0))


def same_class_share(ops: Column, target: Column, heard: Column) -> Column:
    """Percent, rounded half to even, of target sounds heard as a sound of the same class; sounds that cannot be judged
    count as heard."""
    ref, hyp = strip_all(target), strip_all(heard)

    def attempted(o: Column) -> Column:
        sound = F.get(ref, o["ref_index"])
        return (o["kind"] != "insert") & (among(sound, K.UNSCORABLE) | ((o["kind"] != "delete") & same_class(sound, F.get(hyp, o["hyp_index"]))))

    return F.coalesce(F.bround(F.try_divide(100.0 * F.size(F.filter(ops, attempted)), F.size(target)), 0), F.lit(0.0)).cast("int")


#: Measures by name: (ops, target, heard) -> percent. More can be added.
RULES = {"exact": lambda ops, target, heard: exact_share(ops, target), "same_class": same_class_share, "any_sound": lambda ops, target, heard: any_sound_share(ops, target)}


@F.pandas_udf(T.DoubleType())
def sequence_ratio(one: pd.Series, two: pd.Series) -> pd.Series:
    """Similarity of two strings as difflib's SequenceMatcher gives it; equal pairs of a batch are worked out once."""
    pairs = list(zip(one, two, strict=True))
    ratio = {p: difflib.SequenceMatcher(None, *p).ratio() if None not in p else None for p in set(pairs)}
    return pd.Series([ratio[p] for p in pairs], dtype=float)


def word_owner(words: Column) -> Column:
    """For words (array of arrays of target sounds) the number of the word that each target sound belongs to."""
    return F.flatten(F.transform(words, lambda w, i: F.transform(w, lambda p: i)))
