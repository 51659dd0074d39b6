"""Hard negatives by inner product, found with length buckets and sorted coordinate lists.

Vectors are dealt into blocks of one length class; within a block, buckets hold vectors of nearly the same length, longest first, and
for each coordinate of the unit vectors a sorted list. A score that has to be reached becomes, for the length of a bucket, an
angle between query and vector. The angle bounds the value that a coordinate of the vector can have, so of the query's
largest coordinates (the focus) only the rows inside all these ranges are candidates, and only they are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechjobs.llm.common import written

#: Length classes to a doubling of the length; rows of a bucket; focus coordinates of a query.
CLASSES, BUCKET, FOCUS = 8, 2048, 3
#: A bucket in which the ranges leave more than this share of the rows is scored as one matrix product.
DENSE = 0.25
#: Scores that are held at once.
SCORES = 1 << 21
#: Bounds are loosened by this share, so that rounding loses no candidate.
SLACK = 1e-9
ZERO = -(1 << 20)
INDEX = "ids binary, labels binary, vectors binary, lists binary, exact boolean"
ASK = ("anchor", "tie", "given", "given_score")


class LengthBuckets:
    """Rows of one block, longest first, in buckets of BUCKET rows with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.vectors, self.lists = ids, labels, vectors, lists
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / np.where(self.norms > 0, self.norms, 1)[:, None]

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> LengthBuckets:
        """For rows in any order; rows that are equal in all count once."""
        both = np.column_stack([ids, labels, (vectors + 0.0).view(np.int64)])
        keep = np.unique(both, axis=0, return_index=True)[1]
        order = keep[np.lexsort((ids[keep], -(vectors[keep] ** 2).sum(1)))]
        self = cls(ids[order], labels[order], vectors[order], np.zeros((vectors.shape[1], len(order)), np.uint16))
        for at in range(0, len(order), BUCKET):
            self.lists[:, at : at + BUCKET] = np.argsort(self.unit[at : at + BUCKET], axis=0, kind="stable").T
        return self

    def packed(self) -> dict[str, object]:
        """As bytes, in the order of INDEX; vectors of whole numbers below 2^24 take four bytes a component."""
        small = not len(self.vectors) or bool(np.abs(self.vectors).max() < 1 << 24)
        return {"ids": self.ids.tobytes(), "labels": self.labels.tobytes(), "vectors": self.vectors.astype("<f4" if small else "<f8").tobytes(), "lists": self.lists.tobytes(), "exact": not small}

    @classmethod
    def unpacked(cls, dims: int, ids: bytes, labels: bytes, vectors: bytes, lists: bytes, exact: bool) -> LengthBuckets:
        n = len(ids) // 8
        found = np.frombuffer(vectors, "<f8" if exact else "<f4").reshape(n, dims).astype(np.float64)
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), found, np.frombuffer(lists, np.uint16).reshape(dims, n))

    def search(self, asked: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query (``vector``, ``label``, own ``id``, ``low`` and ``high``: the scores asked for, ``least``: a lower bound of the last
        score of the answer) number, ids and scores of its ``k`` best rows with the same label, or with others."""
        queries, least = asked["vector"], np.maximum(asked["low"], asked["least"])
        norms = np.sqrt((queries * queries).sum(1))
        unit = queries / np.where(norms > 0, norms, 1)[:, None]
        n_focus = min(FOCUS, queries.shape[1])
        focus = np.argpartition(-np.abs(unit), n_focus - 1, axis=1)[:, :n_focus] if n_focus else np.zeros((len(queries), 0), np.int64)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at in range(0, len(self.ids), BUCKET):
            rows = slice(at, at + BUCKET)
            reach = norms * self.norms[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where(least > 0, least / reach * (1 - SLACK) - SLACK, -1.0)
            live = np.flatnonzero((cosine <= 1) & (asked["high"] >= asked["low"]))
            if not len(live):
                continue
            low, high, sizes = self._ranges(rows, unit, focus, np.clip(cosine, -1, 1), live)
            thin = sizes < DENSE * len(self.ids[rows])
            parts = [best]
            for q, a, b, f in zip(live[thin].tolist(), low[thin], high[thin], focus[live[thin]], strict=True):
                parts.append(self._some(q, at, asked, least, a, b, f, same))
            step = max(1, SCORES // BUCKET)
            dense = live[~thin]
            parts += [self._all(dense[i : i + step], rows, asked, least, k, same) for i in range(0, len(dense), step)]
            best = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [c[order] for c in best]
            head = np.flatnonzero(np.diff(best[0], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(head, np.diff(head, append=len(order)))
            last = rank == k - 1
            least[best[0][last]] = np.maximum(least[best[0][last]], best[2][last])
            best = [c[rank < k] for c in best]
        return best[0], best[1], best[2]

    def _ranges(self, rows: slice, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each live query's focus coordinates the least and largest feasible value, and the rows in the smallest range.

        With the angle ``own`` between the query and the axis, and ``most`` between query and vector, the vector's angle to
        the axis is within ``most`` of ``own``.
        """
        values = np.take_along_axis(unit, focus, axis=1)[live]
        own, most = np.arccos(np.clip(values, -1, 1)), np.arccos(cosine[live])[:, None]
        low = np.cos(np.minimum(np.pi, own + most)) - SLACK
        high = np.cos(np.maximum(0, own - most)) + SLACK
        sizes = np.full(len(live), len(self.ids[rows]))
        for f in np.unique(focus[live]).tolist():
            listed = self.unit[rows, f][self.lists[f, rows]]
            which, nth = np.nonzero(focus[live] == f)
            found = np.searchsorted(listed, high[which, nth], "right") - np.searchsorted(listed, low[which, nth], "left")
            np.minimum.at(sizes, which, found)
        return low, high, sizes

    def _some(self, q: int, at: int, asked: dict[str, np.ndarray], least: np.ndarray, low: np.ndarray, high: np.ndarray, focus: np.ndarray, same: bool) -> list[np.ndarray]:
        """Rows of a bucket that are inside all ranges of a query: a slice of one list, less those outside of the others."""
        spans = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            listed = self.unit[at : at + BUCKET, f][self.lists[f, at : at + BUCKET]]
            spans.append((int(np.searchsorted(listed, a, "left")), int(np.searchsorted(listed, b, "right"))))
        first = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        rows = at + self.lists[focus[first], at + spans[first][0] : at + spans[first][1]].astype(np.int64)
        for i, f in enumerate(focus.tolist()):
            if i != first:
                rows = rows[(self.unit[rows, f] >= low[i]) & (self.unit[rows, f] <= high[i])]
        score = self.vectors[rows] @ asked["vector"][q]
        fits = ((self.labels[rows] == asked["label"][q]) == same) & (self.ids[rows] != asked["id"][q]) & (score >= least[q]) & (score <= asked["high"][q])
        return [np.full(int(fits.sum()), q), self.ids[rows[fits]], score[fits]]

    def _all(self, queries: np.ndarray, rows: slice, asked: dict[str, np.ndarray], least: np.ndarray, k: int, same: bool) -> list[np.ndarray]:
        """All rows of a bucket against some queries."""
        score = asked["vector"][queries] @ self.vectors[rows].T
        fits = ((self.labels[rows] == asked["label"][queries][:, None]) == same) & (self.ids[rows] != asked["id"][queries][:, None])
        fits &= (score >= least[queries][:, None]) & (score <= asked["high"][queries][:, None])
        score[~fits] = -np.inf
        n = score.shape[1]
        bound = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(queries), -np.inf)
        which, row = np.nonzero(fits & (score >= bound[:, None]))
        return [queries[which], self.ids[rows][row], score[which, row]]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 32_768, block_queries: int = 4096,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of other labels whose
    score is between ``low_percent`` and ``high_percent`` of the positive's.

    Components become ``floor(scale * x)``; the score is the integer inner product with the anchor; higher scores come
    first, ties by smaller id. Rows go to blocks of one length class (at most some 600 classes for each number of
    components), so that a class whose longest vector cannot reach the score asked for is not visited. Each block's lists are
    sorted once and written; queries go to the blocks. Both searches first visit one block, whose last score bounds the answer,
    and then all blocks that can hold more.

    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Defined cases: rows without id or label, and vectors that are null or hold null or non-finite components, take no part;
    vectors are compared with those of the same length only; rows that repeat in id, label and vector count once, rows
    that repeat an id otherwise count each, also as anchors, but never for their own id; positives of negative score have no
    negatives; labels and ids are integers; an empty table gives an empty table; further columns are ignored, whatever their
    names. Scores are exact below 2^53.
    """
    parts = F.col(vector_col).cast("array<double>")
    whole = F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    fine = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    the_label = (F.col(label_col) if label is None else label).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), the_label.alias("label"), F.when(fine, whole).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter("id is not null and label is not null and vector is not null").withColumn("dims", F.size("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).withColumn("class", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * CLASSES)).otherwise(ZERO).cast("int"))
    classes = rows.groupBy("dims", "class").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), F.max("norm").alias("longest")).collect()
    queries = sum(c["asking"] for c in classes)
    fields = "dims int, class int, parts int, longest double, home boolean"
    if not classes:
        classes_seen: list[tuple] = []
    else:
        most = {d: max((c["n"], c["class"]) for c in classes if c["dims"] == d)[1] for d in {c["dims"] for c in classes}}
        classes_seen = [(c["dims"], c["class"], -(-c["n"] // block_rows), c["longest"], most[c["dims"]] == c["class"]) for c in classes]
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame(classes_seen, fields))
    block = ["dims", "class", "part"]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        held = LengthBuckets.of(*(table[c].to_numpy() for c in ("id", "label")), _vectors(table["vector"]))
        return pa.table({c: pa.array([v.as_py()], pa.int32()) for c, v in zip(block, key, strict=True)} | {c: [v] for c, v in held.packed().items()})

    dealt = rows.join(known.select("dims", "class", "parts"), ["dims", "class"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    index = written(dealt.groupBy(*block).applyInArrow(build, f"dims int, class int, part int, {INDEX}"), "index")
    tie = F.xxhash64("label", "vector")
    anchors = rows.filter("asks").select(F.col("id").alias("anchor"), tie.alias("tie"), "label", "vector", "dims", "norm")

    def search(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """Of each row of ``asked`` (ASK, label, vector, dims, norm, low, high, least) the best in the blocks it is sent to."""
        dealt_queries = max(1, -(-queries * (1 if same else positives) // block_queries))
        to = [*block, "ask"]

        def meet(held: pa.Table, want: pa.Table) -> pa.Table:
            found = {c: pa.array([], pa.int64()) for c in (*ASK, "id", "score")}
            if held.num_rows and want.num_rows:
                buckets = LengthBuckets.unpacked(held["dims"][0].as_py(), *(held[c.split()[0]][0].as_py() for c in INDEX.split(", ")))
                columns = {"vector": _vectors(want["vector"]), "label": want["label"].to_numpy(), "id": want["anchor"].to_numpy()} | {c: want[c].to_numpy().astype(np.float64) for c in ("low", "high", "least")}
                which, ids, scores = buckets.search(columns, k, same)
                found = {c: want[c].combine_chunks().take(pa.array(which)) for c in ASK} | {"id": pa.array(ids), "score": pa.array(scores.astype(np.int64))}
            return pa.table(found)

        spread = asked.withColumn("ask", F.pmod(F.xxhash64(*ASK), F.lit(dealt_queries)).cast("int"))
        copies = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(dealt_queries - 1))))
        found = copies.groupBy(*to).cogroup(spread.groupBy(*to)).applyInArrow(meet, ", ".join(f"{c} long" for c in (*ASK, "id", "score")))
        order = Window.partitionBy(*ASK).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def bounded(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """The whole answer: a first round in a block of the most frequent class, then all blocks that can hold more."""
        at = asked.withColumn("least", F.lit(float("-inf"))).join(known, "dims")
        home = at.filter("home").withColumn("part", F.pmod(F.xxhash64("anchor", F.lit("home")), F.col("parts")).cast("int"))
        if len(classes_seen) == 1 and classes_seen[0][2] == 1:
            return search(home, k, same)
        full = search(home, k, same).groupBy(*ASK).agg(F.min("score").cast("double").alias("bound"), F.count("*").alias("n")).filter(F.col("n") == k)
        bounds = written(full.select(*ASK, "bound"), "bounds")
        told = asked.join(bounds, list(ASK), "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf")))).drop("bound").join(known, "dims")
        must = F.greatest("low", "least")
        reaches = (must <= 0) | (F.col("norm") * F.col("longest") * (1 + SLACK) >= must)
        return search(told.filter(reaches).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), k, same)

    any_score = anchors.distinct().withColumns({"given": F.lit(0).cast("long"), "given_score": F.lit(0).cast("long"), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    best = written(bounded(any_score, positives, True).select("anchor", "tie", F.col("id").alias("given"), F.col("score").alias("given_score")), "positives")

    def divided(x: Column, by: int) -> Column:
        """Rounded down."""
        return F.floor((x - F.pmod(x, F.lit(by))) / by).cast("long")

    bands = best.withColumns({"low": -divided(-low_percent * F.col("given_score"), 100), "high": divided(high_percent * F.col("given_score"), 100)}).filter("low <= high")
    asked = anchors.distinct().join(bands.withColumns({c: F.col(c).cast("double") for c in ("low", "high")}), ["anchor", "tie"])
    named = {"anchor_id": "anchor", "positive_id": "given", "rank": "rank", "negative_id": "id", "positive_score": "given_score", "negative_score": "score"}
    return bounded(asked, negatives, False).select(*[F.col(old).alias(new) for new, old in named.items()])
