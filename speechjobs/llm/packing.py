"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from speechjobs.llm.common import WORD, row_key, word_count, written

#: Permitted sequence lengths in words.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: The cost of a sequence: a part that is the same for every sequence, in words, and the length at which attention costs as
#: much as the rest. Short sequences pay the first, long ones the second.
OVERHEAD, ATTENTION = 128, 16384
#: Words of a group of documents that is packed on its own: at most, and at least where there are tasks to spare.
GROUP_WORDS, LEAST_WORDS = 2_000_000, 100_000

_word = re.compile(WORD)


def cost(length: int) -> float:
    """Cost of one sequence: its own overhead, linear work, and attention, which grows with the square."""
    return OVERHEAD + length * (1 + length / ATTENTION)


def _best_fit(sizes: Sequence[int], opened: Sequence[int]) -> tuple[list[int], list[int]]:
    """Bin of each size (given in falling order), and each bin's contents.

    A size goes to the open bin that it leaves the least room in. Where none holds it, a new bin gets the length of the
    least cost for each word that it is expected to hold: the size itself and, in the rest, what is still to come of
    sizes that fit there and for which the open bins have no room.
    """
    falling = [-s for s in sizes]
    tail = np.concatenate([np.cumsum(np.asarray(sizes, np.int64)[::-1])[::-1], [0]]).tolist()
    free: list[tuple[int, int]] = []  # free words and number of each open bin, sorted
    room = 0
    bins: list[int] = []
    at = []
    for i, size in enumerate(sizes):
        k = bisect_left(free, (size, -1))
        if k < len(free):
            space, b = free.pop(k)
            room -= space
        else:

            def for_each_word(x: int) -> tuple[float, int]:
                gap = x - size  # noqa: B023
                coming = tail[max(i + 1, bisect_left(falling, -gap))] if gap else 0  # noqa: B023
                return cost(x) / (size + min(gap, max(0, coming - room))), x  # noqa: B023

            space, b = min((x for x in opened if x >= size), key=for_each_word), len(bins)
            bins.append(0)
        bins[b] += size
        at.append(b)
        if space > size:
            insort(free, (space - size, b))
            room += space - size
    return at, bins


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int]]:
    """Bin of each size and the length of each bin.

    Best fit in falling order of size, ties by place. The lengths are optimised jointly: for every set of the permitted
    lengths that holds the largest size, the packing is tried with new bins of these lengths only; all bins are then
    downsized to the smallest permitted length that holds their contents, and the plan of least total cost stays (of equal
    ones the first, fewer lengths before more).
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    best = None
    for n in range(1, len(lengths) + 1):
        for opened in combinations(lengths, n):
            if falling and opened[-1] >= falling[0]:
                at, bins = _best_fit(falling, opened)
                shrunk = [lengths[bisect_left(lengths, x)] for x in bins]
                total = sum(map(cost, shrunk))
                if best is None or total < best[0]:
                    best = total, at, shrunk
    where = [0] * len(sizes)
    for i, b in zip(order, best[1] if best else (), strict=True):
        where[i] = b
    return where, best[2] if best else []


def _cuts(text: str, longest: int) -> list[str]:
    """A text in pieces of ``longest`` words and a rest, each with the white space between its words."""
    out, begin, end = [], 0, 0
    for k, m in enumerate(_word.finditer(text)):
        if k % longest == 0:
            if k:
                out.append(text[begin:end])
            begin = m.start()
        end = m.end()
    return [*out, text[begin:end]]


def _with_texts(packed: DataFrame, texts: DataFrame, longest: int) -> DataFrame:
    """Give pieces the texts of their rows. A row meets its text once, with all its pieces; only texts of several pieces
    are cut, a batch at a time."""

    @F.pandas_udf(ArrayType(StringType()))
    def cuts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else _cuts(t, longest))

    columns = [c for c in packed.columns if c not in ("row", "piece")]
    rows = packed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", F.struct(*columns).alias("rest")))).alias("pieces")).join(texts, "row")
    rows = rows.select("pieces", "text", cuts(F.when(F.size("pieces") > 1, F.col("text"))).alias("cuts"))
    each = rows.select(F.explode(F.arrays_zip("pieces", F.coalesce("cuts", F.array("text")).alias("text"))).alias("p"))
    return each.select(*[(F.col("p.pieces.piece") if c == "piece" else F.col(f"p.pieces.rest.{c}")).alias(c) for c in packed.columns if c != "row"], F.col("p.text").alias("text"))


def pack_documents(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS, with_text: bool = False
) -> DataFrame:
    """Pack all words of all documents into sequences of permitted lengths.

    Documents are dealt by a hash of the row and its place in the table into groups of at most about ``group_words`` words, smaller ones where there
    are shuffle partitions to spare; each group is packed on its own, so packing is spread over the cluster and a task
    holds the sizes of one group. A document longer than the longest length is cut into pieces of that length and a rest. Words are
    counted once; texts do not pass through the packer. For ``with_text`` they are written once with a number for each row,
    by which the pieces find them again.

    Returns one row for each piece: id, ``row_id`` (string, one for each row of ``docs``), ``piece`` (from 0), ``first_word``,
    ``words``, ``bin`` (string, unique in the table), ``bin_length`` (permitted length), ``bin_words`` (words in the bin),
    ``bin_start`` (place in the bin) and, for ``with_text``, ``text`` (of the piece). The pieces of a bin in the order of
    ``bin_start`` are its sequence.

    Defined cases: null texts and texts without words have no pieces; rows that repeat an id, or an id and a text, are
    packed each on its own, spread over the groups, and share their id; null ids are kept as null; an empty table gives an empty table; further
    columns are ignored, whatever their names.
    """
    longest = max(lengths)
    columns = [F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("n"), row_key(docs, id_col, text_col).alias("key")]
    texts = [F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")] if with_text else []
    sized = written(docs.select(*columns, *texts).filter("n > 0"), "sizes")
    total = sized.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = int(max(1, -(-total // group_words), min(tasks, -(-total // min(LEAST_WORDS, group_words)))))
    # with the place in the table, so that rows that repeat, as many as there may be, are spread
    place = F.col("row") if with_text else F.monotonically_increasing_id()
    dealt = sized.drop("text").withColumn("pack", F.pmod(F.xxhash64("key", place), F.lit(groups)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(np.lexsort((table["n"].to_numpy(), table["key"].to_numpy())))
        pieces = [(row, k, first, min(longest, n - first)) for row, n in enumerate(table["n"].to_pylist()) for k, first in enumerate(range(0, n, longest))]
        row, piece, first, words = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        where, shrunk = pack_sizes(words.tolist(), lengths)
        used, start = [0] * len(shrunk), []
        for b, n in zip(where, words.tolist(), strict=True):
            start.append(used[b])
            used[b] += n
        pack_id = table["pack"][0].as_py()
        out = {
            "id": table["id"].take(row), "row_id": [f"{pack_id}-{r}" for r in row.tolist()], "piece": piece.astype(np.int32), "first_word": first, "words": words, "bin": [f"{pack_id}-{b}" for b in where],
            "bin_length": np.array([shrunk[b] for b in where], np.int32), "bin_words": np.array([used[b] for b in where], np.int64), "bin_start": np.array(start, np.int64),
        }
        if with_text:
            out["row"] = table["row"].take(row)
        return pa.table(out)

    kinds = {"row_id": StringType(), "piece": IntegerType(), "first_word": LongType(), "words": LongType(), "bin": StringType(), "bin_length": IntegerType(), "bin_words": LongType(), "bin_start": LongType()}
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(c, t) for c, t in kinds.items()), *([StructField("row", LongType())] if with_text else [])])
    packed = dealt.groupBy("pack").applyInArrow(pack, schema)
    return (_with_texts(packed, sized.select("row", "text"), longest) if with_text else packed).withColumnRenamed("id", id_col)
