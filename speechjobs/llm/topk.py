"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechjobs.llm.common import written

#: Sorted access begins with this many entries of each list and doubles.
FIRST_DEPTH = 16


class SortedLists:
    """A block of vectors with one sorted list of rows for each dimension. Rows are in id order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.lists = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than ``own``: larger scores first, ties by smaller id. Rows with a score
        below ``least``, the kth score of other rows, are left out.

        Lists are read from the end that helps the score most. No row that is still unseen can beat the sum of what
        the lists show at the depth reached, so the search stops once the kth score, or ``least``, is above that sum; an
        equal sum goes on, for an unseen row of that score may have a smaller id.
        """
        n = len(self.ids)
        score = np.full(n, -np.inf)
        seen = np.zeros(n, bool)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        done, depth = 0, min(n, FIRST_DEPTH)
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.lists[up, n - depth : n - done]] = True
            fresh[self.lists[down, done:depth]] = True
            if not len(up) + len(down):
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen[rows] = True
            score[rows] = self.vectors[rows] @ query
            score[rows[self.ids[rows] == own]] = -np.inf
            if depth == n or seen.all():
                break
            bound = self.values[up, n - depth] @ query[up] + self.values[down, depth - 1] @ query[down]
            if least > bound or n > k and np.partition(score, n - k)[n - k] > bound:
                break
            done, depth = depth, min(n, 2 * depth)
        found = np.flatnonzero((score > -np.inf) & (score >= least))
        best = found[np.lexsort((self.ids[found], -score[found]))][:k]
        return self.ids[best], score[best]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and bounds of a table (id, vector, least) whose vectors have one length; equal rows count once."""
    ids = table["id"].to_numpy()
    vectors = table["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
    least = table["least"].to_numpy() if "least" in table.column_names else np.full(len(ids), -np.inf)
    if len(np.unique(ids)) < len(ids):
        # all numbers by their 64 bits: ids are exact, and vectors hold whole numbers
        both = np.column_stack([ids.view(np.int64), vectors.view(np.int64)])
        keep = np.sort(np.unique(both, axis=0, return_index=True)[1])
        ids, vectors, least = ids[keep], vectors[keep], least[keep]
    return ids, vectors, least


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 32_768, block_queries: int = 16_384) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query row, among all rows but those of its own id.

    Components become ``floor(scale * x)``. Rows and queries are dealt by a hash of the id into blocks of bounded size;
    every pair of a row block and a query block is one task's work, in which the row block's lists are sorted once and
    each query runs the threshold algorithm on them. A first round meets each query with one row block; the kth score
    found there is the bound with which it goes to all row blocks, so that most of these stop early. A query's best of all
    blocks are then ranked.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Defined cases: rows without id, and vectors that are null or hold null or non-finite components, take no part;
    vectors are compared with those of the same length only; repeats of an id with the same vector count once; ties go to
    the smaller id; further columns are ignored, whatever their names; an empty table gives an empty table. Ids are any
    64-bit integers. Scores are exact below 2^53.
    """
    parts = F.col(vector_col).cast("array<double>")
    whole = F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    fine = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"), is_query.alias("query"))
    n, queries = rows.agg(F.count("*"), F.count_if(F.coalesce("query", F.lit(False)))).first()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-queries // block_queries))
    length = F.size("vector").alias("length")

    def dealt(salt: int, blocks: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    keys = ["length", "row_block", "query_block"]

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if block.num_rows and asked.num_rows:
            lists = SortedLists(*_matrix(block)[:2])
            for query_id, query, least in zip(*_matrix(asked), strict=True):
                ids, scores = lists.search(query, query_id, k, least)
                out[0].append(np.full(len(ids), query_id))
                out[1].append(ids)
                out[2].append(scores)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from the same rows
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    left = rows.select("id", "vector", length, dealt(1, row_blocks).alias("row_block"), every(query_blocks).alias("query_block"))
    asked = rows.filter("query").select("id", "vector", length, dealt(2, query_blocks).alias("query_block"))
    if row_blocks == 1:
        return meet(left, asked.withColumn("row_block", F.lit(0)))
    home = asked.withColumn("row_block", dealt(3, row_blocks))
    # an id that repeats with several vectors has candidates of each, so only a full list of k bounds them all
    found = meet(left, home).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == k)
    bounds = written(found.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least")), "bounds")
    bounded = asked.join(bounds, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return meet(left, bounded.withColumn("row_block", every(row_blocks)))
