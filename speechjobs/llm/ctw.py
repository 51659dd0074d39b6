"""Language-model scoring by context-tree weighting over binary-decomposed bytes, and a unigram base to compare with.

A byte is eight binary decisions; each decision (the bits before it in the byte) has a context tree over the bytes
before. A node at depth d, for d bytes of context, holds how often its decision was 0 and 1, which gives its
Krichevsky-Trofimov estimate. The weighted probability of a node mixes, half and half, its own estimate and the product
of its children's weighted probabilities; for the next bit this makes a mixture of the estimates of all depths. A node
that was met once is a leaf: below it all estimates are the same, and no tails are kept.

Everything follows from the counts of strings of DEPTH + 1 bytes over all training texts. They lie in buckets of the NEAR
bytes before the last one, which hold all nodes from depth NEAR on; what is above is small and goes to the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from speechjobs.llm.common import written
from speechjobs.llm.hashing import LOWER, distinct, mix, runs_of, sliced, token_hashes, tokens

#: Bytes of context: with the byte itself a string fills 64 bits.
DEPTH = 7
#: Bytes of context that name a bucket.
NEAR = 3
#: Bytes that stand before and after a text; UTF-8 does not use them.
BEGIN, END = 0xFE, 0xFF
#: A task works on this much text at once.
WORK_BYTES = 1 << 20
#: Text that a task holds before it sends the counts of its strings, and strings asked of one bucket's task, about.
HELD_BYTES, ASKED = 8 << 20, 3_000_000
#: Most buckets; their sizes are what the driver learns of them.
MOST_BUCKETS = 1 << 16
#: Answers are square roots of -log10 p in steps of 1 / SCALE, of 24 bits.
SCALE = 2.0**20


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones, compressed; sorted numbers take little room."""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    flat = np.empty((x.itemsize, len(x)), np.uint8)
    for i in range(x.itemsize):  # a column at a time is faster than the whole transposed
        flat[i] = rows[:, i]
    return zstandard.ZstdCompressor(level=1).compress(flat)


def expand(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    rows = np.empty(flat.shape[::-1], np.uint8)
    for i in range(len(flat)):
        rows[:, i] = flat[i]
    return rows.view(kind).ravel()


def squeeze_logs(x: np.ndarray) -> bytes:
    """log10 probabilities above -256, to about 1e-6."""
    return squeeze(np.rint(np.sqrt(-x) * SCALE).astype(np.uint32))


def expand_logs(data: bytes) -> np.ndarray:
    return -((expand(data, np.uint32) / SCALE) ** 2)


def byte_strings(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end: the number made of DEPTH bytes before and the byte, and its text. Bytes
    are taken as they are, but for A-Z."""
    head = bytes([BEGIN]) * DEPTH
    data = LOWER[np.frombuffer(b"".join(x for r in raw for x in (head, r, bytes([END]))), np.uint8)]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    doc = np.repeat(np.arange(len(raw)), sizes)
    if not len(data):
        return np.zeros(0, np.uint64), doc
    # the eight bytes from each place on, read as one number
    code = np.ndarray(len(data) - DEPTH, ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    return code[np.arange(len(doc)) + doc * DEPTH], doc


def sorted_strings(raw: list[bytes]) -> np.ndarray:
    """The numbers of byte_strings() for all texts, sorted in one array."""
    every, end = np.empty(sum(len(r) + 1 for r in raw), np.uint64), 0
    for rows in runs_of(np.array([len(r) for r in raw]), WORK_BYTES):
        new = byte_strings([raw[r] for r in rows])[0]
        every[end : end + len(new)] = new
        end += len(new)
    every.sort()
    return every


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series at x + 8."""
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - down


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    z, o = np.asarray(zeros, float), np.asarray(ones, float)
    return log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1) - np.log(np.pi)


#: Values for small counts, which most nodes have.
SMALL = 128
_small = _log_kt(*np.indices((SMALL, SMALL)))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    out = _small[np.minimum(zeros, SMALL - 1).astype(np.int64), np.minimum(ones, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero((zeros >= SMALL) | (ones >= SMALL))
    out[large] = _log_kt(zeros[large], ones[large])
    return out


#: Odd numbers, from which a slot's number is made.
SLOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Places:
    """Finds the places of codes in ``known`` (distinct, sorted): through tables of slots, each for the codes that found no
    slot of their own in the ones before, else by binary search."""

    def __init__(self, known: np.ndarray):
        self.known, self.tables = known, []
        left = np.arange(len(known), dtype=np.int32)
        for odd in SLOTS:
            bits = min(24, max(8, len(left).bit_length() + 1))
            table = np.zeros(1 << bits, np.int32)
            self.tables.append((np.uint64(odd), np.uint64(64 - bits), table))
            slot = self.slot(known[left], *self.tables[-1][:2])
            table[slot] = left
            left = left[table[slot] != left]
            if not len(left):
                break

    @staticmethod
    def slot(codes: np.ndarray, odd: np.uint64, shift: np.uint64) -> np.ndarray:
        product = codes * odd
        product >>= shift
        return product.view(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes that are all known."""
        out, open_ = np.zeros(len(codes), np.int32), None
        for odd, shift, table in self.tables:
            at = table[self.slot(codes, odd, shift)]
            wrong = np.flatnonzero(self.known[at] != codes)
            if open_ is None:
                out, open_ = at, wrong
            else:
                out[open_] = at
                open_ = open_[wrong]
            codes = codes[wrong]
            if not len(wrong):
                break
        else:
            out[open_] = np.searchsorted(self.known, codes)
        return out


def heads(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of some sorted arrays, which are given up."""
    every = np.concatenate(parts)
    parts.clear()
    every.sort(kind="stable")  # merges what is sorted
    return every[heads(every)]


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings, sorted, and their counts."""
    both, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    at = heads(both)
    return both[at], np.add.reduceat(n, at) if len(at) else n


def merged_in_steps(parts: Iterator[tuple[np.ndarray, np.ndarray]], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """merged() of many parts that are made one by one, of which no more is held than ``step`` strings, a part, and twice
    the distinct ones."""
    codes, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for c, n in parts:
        codes.append(c)
        counts.append(n)
        size += len(c)
        if size >= max(step, len(codes[0])):
            one, sums = merged(codes, counts)
            codes, counts, size = [one], [sums], 0
    return merged(codes, counts)


def near_bucket(codes: np.ndarray, buckets: int, near: int) -> np.ndarray:
    out = np.empty(len(codes), np.int32)
    for a in range(0, len(codes), WORK_BYTES // 8):  # what lies between is eight bytes wide
        context = (codes[a : a + WORK_BYTES // 8] >> np.uint64(8)) & np.uint64((1 << (8 * near)) - 1)
        out[a : a + len(context)] = mix(context + np.uint64(1)) % np.uint64(buckets)
    return out


def in_order(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Rows by bucket, in their order within each; numbers of two bytes are sorted by their bytes."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= MOST_BUCKETS else bucket, kind="stable")


def slices(by: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = np.append(np.flatnonzero(np.diff(by, prepend=by[:1] - 1)), len(by)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def count_strings(docs: DataFrame, buckets: int = 1, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(bucket, n, codes, counts): how often each string occurs in all texts, packed, in one or more rows for a bucket;
    ``n`` is their number. Null texts count as empty."""

    def send(held: list[bytes]) -> pa.RecordBatch:
        every = sorted_strings(held)
        at = heads(every)
        codes, counts = every[at], np.diff(at, append=len(every))
        del every, at
        bucket = near_bucket(codes, buckets, near)
        order = in_order(bucket, buckets)
        codes, counts, bucket = codes[order], counts[order].astype(np.uint32), bucket[order]
        rows = [(int(bucket[a]), b - a, squeeze(codes[a:b]), squeeze(counts[a:b])) for a, b in slices(bucket)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "codes", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in sliced(batches):
            for text in batch["text"].to_pylist():
                held.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= HELD_BYTES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long, codes binary, counts binary")


def decisions(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each string at bit ``k`` of its byte, and the bit: the bits before it with a 1 in front, then the bytes of
    context from the nearest on. Nodes of depth d share the first 1 + d bytes of their keys."""
    byte = codes & np.uint64(255)
    at = (byte + np.uint64(256)) >> np.uint64(8 - k)
    return (at << np.uint64(56)) | ((codes >> np.uint64(8)).byteswap() >> np.uint64(8)), ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)


def climb(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, to: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes depth by depth, from the deepest to depth ``to``: (depth, keys, zeros, ones, ln of the weighted probability, ln
    of the children's product over the own estimate), from sorted keys with counts."""
    weighted = ahead = np.zeros(0)
    for d in range(DEPTH, to - 1, -1):
        if d < DEPTH:
            key = key >> np.uint64(8)
        head = heads(key)
        key, zeros, ones = key[head], np.add.reduceat(zeros, head), np.add.reduceat(ones, head)
        own = log_kt(zeros, ones)
        if d == DEPTH:
            weighted, ahead = own, np.full(len(key), -np.inf)
        else:
            weighted, ahead = mixed(own, np.add.reduceat(weighted, head), zeros + ones)
        yield d, key, zeros, ones, weighted, ahead


def mixed(own: np.ndarray, below: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of half the own estimate and half the children's product, and how far the children are ahead; leaves have none."""
    ahead = np.where(n > 1, below - own, -np.inf)
    return np.where(n > 1, np.maximum(below, own) + np.log1p(np.exp(-np.abs(below - own))) - np.log(2.0), own), ahead


def predict(codes: np.ndarray, counts: np.ndarray, upper: dict[int, tuple[np.ndarray, ...]], near: int = NEAR) -> np.ndarray:
    """log10 probability of each string's last byte after the others, from the counts (0: not learned) of all strings of
    some buckets, and the nodes above: ``upper`` has (keys, zeros, ones, ahead) for each depth below ``near``.

    From the shortest context on, a met node hands 1 / (1 + e^ahead) of the weight to its own estimate and the rest to the
    next longer context; what is left where a context was never met goes to a half.
    """
    total = np.zeros(len(codes))
    for k in range(8):
        key, bit = decisions(codes, k)
        order = np.argsort(key)
        key, bit, n = key[order], bit[order], counts[order]
        share = np.full(len(codes), 0.5)

        def blend(share: np.ndarray, row: np.ndarray, zeros: np.ndarray, ones: np.ndarray, ahead: np.ndarray) -> np.ndarray:
            met = zeros + ones
            with np.errstate(over="ignore"):
                own, rest = 1 / (1 + np.exp(ahead)), 1 / (1 + np.exp(-ahead))
            # a decision that was never met leaves the share as it is
            own, rest = np.where(met > 0, own, 0.0), np.where(met > 0, rest, 1.0)
            mine = np.where(bit, ones[row], zeros[row])  # noqa: B023
            return own[row] * (mine + 0.5) / (met[row] + 1) + rest[row] * share

        row_key = key
        for d, _, zeros, ones, _, ahead in climb(key, n * (1 - bit), n * bit, near):
            if d < DEPTH:
                row_key = row_key >> np.uint64(8)
            share = blend(share, np.cumsum(np.diff(row_key, prepend=~row_key[:1]) != 0) - 1, zeros, ones, ahead)
        for d in range(near - 1, -1, -1):
            row_key = row_key >> np.uint64(8)
            keys, zeros, ones, ahead = upper[d]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, row_key), len(keys) - 1)
                there = keys[at] == row_key
                share = np.where(there, blend(share, at, zeros, ones, ahead), share)
        total[order] += np.log10(share)
    return total


@F.pandas_udf(DoubleType())
def _log_kt_of(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    return pd.Series(log_kt(zeros.to_numpy(), ones.to_numpy()))


def upper_nodes(strings: DataFrame, near: int = NEAR) -> DataFrame:
    """Nodes (depth, key, zeros, ones, ahead) of the depths below ``near``. Each bucket of (bucket, codes, counts) gives its
    nodes of depth ``near``; counts and ln probabilities are then summed by the shorter context, depth by depth."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch["codes"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                codes, counts = expand(codes, np.uint64), expand(counts, np.int64)
                for k in range(8):
                    key, bit = decisions(codes, k)
                    order = np.argsort(key)
                    *_, (_, at, zeros, ones, weighted, _) = climb(key[order], (counts * (1 - bit))[order], (counts * bit)[order], near)
                    yield pa.RecordBatch.from_pydict({"key": at.astype(np.int64), "zeros": zeros, "ones": ones, "weighted": weighted})

    level = strings.select("codes", "counts").mapInArrow(nodes, "key long, zeros long, ones long, weighted double")
    found = None
    for d in range(near - 1, -1, -1):
        sums = level.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        sums = sums.withColumn("own", _log_kt_of("zeros", "ones"))
        several, gap = F.col("zeros") + F.col("ones") > 1, F.abs(F.col("below") - F.col("own"))
        weighted = F.when(several, F.greatest("below", "own") + F.log1p(F.exp(-gap)) - F.log(F.lit(2.0))).otherwise(F.col("own"))
        ahead = F.when(several, F.col("below") - F.col("own")).otherwise(F.lit(float("-inf")))
        level = written(sums.select("key", "zeros", "ones", weighted.alias("weighted"), ahead.alias("ahead")), f"tree-{d}")
        part = level.select(F.lit(d).alias("depth"), "key", "zeros", "ones", "ahead")
        found = part if found is None else found.unionByName(part)
    return found


#: A row for each bucket: nodes of one depth, packed.
PACKED = "bucket int, depth int, key binary, zeros binary, ones binary, ahead binary"
KINDS = {"key": np.uint64, "zeros": np.int64, "ones": np.int64, "ahead": np.float64}


def extended(key: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes of depth ``depth``: (node, bucket) for each bucket that has a context of one more byte, by bucket."""
    context = np.zeros(len(key), np.uint64)
    for i in range(depth):
        # the nearest byte is the highest of a key, and the lowest of a string's context
        context |= ((key >> np.uint64(8 * (depth - 1 - i))) & np.uint64(255)) << np.uint64(8 * i)
    known, which = np.unique(context, return_inverse=True)
    longer = known[:, None] | (np.arange(256, dtype=np.uint64) << np.uint64(8 * depth))[None]
    to = np.sort((mix(longer + np.uint64(1)) % np.uint64(buckets)).astype(np.int64), axis=1)
    first = np.column_stack([np.ones(len(to), bool), to[:, 1:] != to[:, :-1]])
    n = first.sum(1)
    begin = np.cumsum(n) - n
    node = np.repeat(np.arange(len(key)), n[which])
    nth = np.arange(len(node)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
    bucket = to[first][begin[which[node]] + nth]
    order = np.argsort(bucket, kind="stable")
    return node[order], bucket[order]


def shipped(nodes: DataFrame, buckets: int, first: np.ndarray, salts: np.ndarray, near: int = NEAR) -> DataFrame:
    """Nodes above depth ``near``, as packed rows of the parts ``first`` to ``first`` + ``salts`` - 1 of each bucket.

    Nodes of the last depth go only to the buckets of contexts that are one byte longer, 256 at most. Those above are
    65,535 at most, whatever the corpus, and go to all parts.
    """
    spark, names = nodes.sparkSession, list(KINDS)

    def packed(columns: dict[str, np.ndarray], rows: np.ndarray) -> tuple:
        return tuple(squeeze(columns[c][rows].astype(KINDS[c])) for c in names)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * len(names))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "depth", *names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch[c].to_numpy() for c in names}
            node, bucket = extended(columns["key"].astype(np.uint64), near - 1, buckets)
            rows: list[tuple] = []
            for x, y in slices(bucket):
                one = (near - 1, *packed(columns, node[x:y]))
                rows += [(int(first[bucket[x]]) + salt, *one) for salt in range(salts[bucket[x]])]
                if len(rows) >= 1024:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def pack(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in names}
        return pa.Table.from_batches([as_batch([(-1, table["depth"][0].as_py(), *packed(columns, np.arange(table.num_rows)))])])

    by_context = F.col("key").bitwiseAND(F.lit((1 << (8 * (near - 1))) - 1))
    last = nodes.filter(F.col("depth") == near - 1).select(*names).repartition(by_context).sortWithinPartitions(by_context).mapInArrow(send, PACKED)
    above = nodes.filter(F.col("depth") < near - 1).groupBy("depth").applyInArrow(pack, PACKED).drop("bucket")
    parts = spark.range(int(first[0]), int(first[-1] + salts[-1])).select(F.col("id").cast("int").alias("bucket"))
    return last.unionByName(parts.crossJoin(F.broadcast(above)))


def upper_arrays(table: pa.Table, near: int = NEAR) -> dict[int, tuple[np.ndarray, ...]]:
    """The nodes of packed rows by depth, sorted."""
    depth = np.array(table["depth"].to_pylist(), np.int64)
    out = {}
    for d in range(near):
        rows = np.flatnonzero(depth == d)
        columns = [np.concatenate([np.zeros(0, kind), *(expand(table[c][i].as_py(), kind) for i in rows)]) for c, kind in KINDS.items()]
        order = np.argsort(columns[0])
        out[d] = tuple(c[order] for c in columns)
    return out


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20, near: int = NEAR) -> DataFrame:
    """Score every whole text with context-tree weighting and with an add-one unigram base, both learned from the texts
    that are not held out. A-Z are lowered, all other bytes are scored as they are.

    Texts are dealt into chunks by a hash of the id. A chunk sends each of its distinct words, with its training count, to
    the bucket of the word's 64-bit hash, and each of its distinct byte strings to the bucket of the ``near`` bytes before
    the last one. Word buckets add up counts; string buckets hold that part of the tree and compute probabilities. They
    answer in the order in which they were asked, and the chunk sums up its texts. A word or string that is everywhere is
    one entry for each chunk; buckets of which much is asked, by the counts of the first pass, are split by chunks into
    several that hold the same strings. Nothing of the model goes through the driver but the number of strings of each of
    at most MOST_BUCKETS buckets. The texts are shuffled once.

    Returns id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10), ``bytes`` (of the text)
    and ``bits_per_byte`` (the end of the text counts as a byte).

    Defined cases: null text is empty; an empty text is its end alone; rows with a null id, for which ``held_out`` is
    null, are learned from; repeated rows count and are scored each; with nothing to learn from every bit costs one bit;
    an empty table gives an empty table; further columns are ignored, whatever their names.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks = int(max(1, -(-total // max(chunk_bytes, total >> 20))))
    buckets = min(chunks, MOST_BUCKETS)
    number = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(chunks)).cast("int")
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), number.alias("chunk"))

    def gather(table: pa.Table) -> pa.Table:
        codes, counts = merged_in_steps((expand(x, np.uint64), expand(y, np.uint32).astype(np.int64)) for x, y in zip(table["codes"].to_pylist(), table["counts"].to_pylist(), strict=True))
        return pa.table({"bucket": table["bucket"][:1], "asked": pa.array([sum(table["n"].to_pylist())], pa.int64()), "codes": pa.array([squeeze(codes)], pa.binary()), "counts": pa.array([squeeze(counts)], pa.binary())})

    strings = written(count_strings(keyed.filter("not held_out"), buckets, near=near).groupBy("bucket").applyInArrow(gather, "bucket int, asked long, codes binary, counts binary"), "strings")
    # a bucket's number, and in how many parts its questions are split
    salts = np.ones(buckets, np.int64)
    for r in strings.select("bucket", "asked").collect():  # at most MOST_BUCKETS rows
        salts[r["bucket"]] = -(-r["asked"] // ASKED)
    first = chunks + np.cumsum(salts) - salts
    parts = docs.sparkSession.createDataFrame(pd.DataFrame({"at": np.arange(buckets), "first": first, "salts": salts}))

    # buckets: 0 .. chunks - 1 of words, then (bucket, salt) of strings; the salt is the chunk's
    spread = F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("salts") - 1).cast("int"))).alias("bucket")
    learned = strings.join(F.broadcast(parts), F.col("bucket") == F.col("at")).select(spread, "codes", "counts")
    tree = learned.unionByName(shipped(upper_nodes(strings, near), buckets, first, salts, near), allowMissingColumns=True)

    def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
        """Distinct word hashes in the order of buckets; each word's place among them; each word's text."""
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for rows in runs_of(np.array([len(t) for t in texts]), WORK_BYTES):
            data, start, end, doc = tokens([texts[r] for r in rows])
            hashes.append(token_hashes(data, start, end))
            docs.append(rows[doc])
        doc = np.concatenate(docs)
        every = np.concatenate(hashes)
        words = distinct(every)
        order = in_order(words % np.uint64(chunks), chunks)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return words[order], place[Places(words).of(every)], doc

    def strings_of(raw: list[bytes]) -> np.ndarray:
        """Distinct strings, sorted."""
        found = [np.zeros(0, np.uint64)]
        for rows in runs_of(np.array([len(r) for r in raw]), HELD_BYTES):
            every = sorted_strings([raw[r] for r in rows])
            found.append(every[heads(every)])
            del every
        return joined(found)

    def by_bucket(codes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of strings by the bucket that is asked, and these buckets in that order."""
        near_one = near_bucket(codes, buckets, near)
        order = in_order(near_one, buckets)  # parts of a bucket follow each other
        near_one = near_one[order]
        return order, first[near_one] + chunk % salts[near_one]

    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        words, which, doc = words_of(table["text"].to_pylist())
        counts = np.bincount(which, ~table["held_out"].to_numpy()[doc], len(words)).astype(np.int64)
        del which, doc
        bucket = (words % np.uint64(chunks)).astype(np.int64)
        rows = [(int(bucket[a]), chunk, squeeze(words[a:b]), squeeze(counts[a:b])) for a, b in slices(bucket)]
        codes = strings_of([t.encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()])
        order, bucket = by_bucket(codes, chunk)
        codes = codes[order]
        rows += [(int(bucket[a]), chunk, squeeze(codes[a:b]), b"") for a, b in slices(bucket)]
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "keys", "counts"])

    def answer(asked: pa.Table, tree: pa.Table) -> pa.Table:
        sent = asked["keys"].to_pylist()
        n_types, n_tokens = [0] * len(sent), [0] * len(sent)
        parts: list[bytes] = []
        if sent:
            keys = joined([expand(x, np.uint64) for x in sent])
            if asked["bucket"][0].as_py() < chunks:
                places = Places(keys)
                which = [places.of(expand(x, np.uint64)) for x in sent]
                values = sum(np.bincount(w, expand(x, np.int64), len(keys)) for w, x in zip(which, asked["counts"].to_pylist(), strict=True)).astype(np.int64)
                n_types[0], n_tokens[0] = int((values > 0).sum()), int(values.sum())
                parts = [squeeze(values[w]) for w in which]
            else:
                packed = tree.filter(pa.compute.is_valid(tree["codes"]))
                codes, counts = merged([keys, *(expand(x, np.uint64) for x in packed["codes"].to_pylist())], [np.zeros(len(keys), np.int64), *(expand(x, np.int64) for x in packed["counts"].to_pylist())])
                logs = predict(codes, counts, upper_arrays(tree.filter(pa.compute.is_valid(tree["depth"])), near), near)
                places = Places(codes)
                parts = [squeeze_logs(logs[places.of(expand(x, np.uint64))]) for x in sent]
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "data": pa.array(parts, pa.binary()), "types": pa.array(n_types, pa.int64()), "tokens": pa.array(n_tokens, pa.int64())})

    def add(texts: pa.Table, answers: pa.Table) -> pa.Table:
        n, chunk = texts.num_rows, texts["chunk"][0].as_py()
        order = np.argsort(answers["bucket"].to_numpy(), kind="stable")
        bucket, data = answers["bucket"].to_numpy()[order], answers["data"].to_pylist()
        blobs = [data[i] for i in order]
        n_words = int((bucket < chunks).sum())
        _, which, doc = words_of(texts["text"].to_pylist())
        counts = np.concatenate([np.zeros(0, np.int64), *(expand(x, np.int64) for x in blobs[:n_words])])[which]
        of_words = {"n": np.bincount(doc, minlength=n).astype(np.int64), "known": np.bincount(doc, counts > 0, n).astype(np.int64), "logs": np.bincount(doc, np.log10(counts + 1.0), n)}
        del which, doc, counts
        raw = [t.encode("utf-8", "surrogatepass") for t in texts["text"].to_pylist()]
        codes = strings_of(raw)
        value, order, end = np.empty(len(codes)), by_bucket(codes, chunk)[0], 0
        for logs in map(expand_logs, blobs[n_words:]):
            value[order[end : end + len(logs)]] = logs
            end += len(logs)
        del order, data, blobs
        places, score, length = Places(codes), np.zeros(n), np.zeros(n, np.int64)
        for rows in runs_of(np.array([len(r) for r in raw]), WORK_BYTES):
            mine, of = byte_strings([raw[r] for r in rows])
            score[rows] = np.bincount(of, value[places.of(mine)], len(rows))
            length[rows] = np.bincount(of, minlength=len(rows)) - 1
        scored = pa.table({"id": texts["id"], "held_out": texts["held_out"], **of_words, "score": score, "bytes": length})
        # and a row for the distinct words and tokens of the word buckets that this chunk was told of
        told = {"n": pa.array([sum(answers["types"].to_pylist())], pa.int64()), "known": pa.array([sum(answers["tokens"].to_pylist())], pa.int64())}
        return pa.concat_tables([scored, pa.table({k.name: told.get(k.name, pa.nulls(1, k.type)) for k in scored.schema})])

    asked = keyed.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, keys binary, counts binary")
    answers = asked.groupBy("bucket").cogroup(tree.groupBy("bucket")).applyInArrow(answer, "chunk int, bucket int, data binary, types long, tokens long")
    figures_of = {"n": LongType(), "known": LongType(), "logs": DoubleType(), "score": DoubleType(), "bytes": LongType()}
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("held_out", BooleanType()), *(StructField(c, t) for c, t in figures_of.items())])
    # read once: answers that a second branch of the plan took would be computed twice
    both = written(keyed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, schema), "scores")
    is_text = F.col("held_out").isNotNull()
    words, types, ends = both.agg(F.sum(F.when(~is_text, F.col("known"))), F.sum(F.when(~is_text, F.col("n"))), F.count_if(~F.col("held_out"))).first()
    # the end of a text is a token too: one in each training text
    n, v = (words or 0) + ends, (types or 0) + (ends > 0)
    base = F.col("logs") + F.log10(F.lit(float(ends + 1))) - (F.col("n") + 1) * F.log10(F.lit(float(n + v + 1)))
    bits = -F.col("score") * float(np.log2(10)) / (F.col("bytes") + 1)
    return both.filter(is_text).select(
        F.col("id").alias(id_col), "held_out", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", "bytes", bits.alias("bits_per_byte"),
    )
