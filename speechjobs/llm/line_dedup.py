"""Removal of lines that many documents share, through a sharded minimal perfect hash of the lines' hashes.

Each shard holds the distinct lines of one part of the hash space: a perfect hash gives a line its place in arrays of
fingerprints and document counts. Documents send the hashes of their lines, packed, to the shards and get back which of
them are common; no line is joined and no text of a line is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from speechjobs.llm.common import written
from speechjobs.llm.hashing import mix, sliced

#: Bits of a level for each key that is left.
BITS_PER_KEY = 2
STEP = 0x9E3779B97F4A7C15
#: Bytes that continue a character in UTF-8.
CONTINUE = bytes(range(0x80, 0xC0))
#: A line's hash, then the line's documents.
HASH = np.dtype([("one", "<u8"), ("two", "<u8")])


def line_key(line: bytes) -> bytes:
    """A line of UTF-8 without white space at its ends, A-Z lowered."""
    return line.strip(b" \t\n\v\f\r").lower()


def line_hashes(text: bytes, min_chars: int) -> list[bytes]:
    """For each line the 16-byte hash of its key, or nothing if the key has under ``min_chars`` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, CONTINUE)) >= min_chars)
        out.append(blake2b(key, digest_size=16).digest() if long else b"")
    return out


class PerfectHash:
    """A minimal perfect hash: each key has a place of its own in 0..n-1.

    A key stands in the first level in which no other key that got so far has its bit; its place is the number of bits
    set before it. Levels have two bits for each key that is left, so a key costs under four bits in all.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(x, dtype=np.int64) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])]).astype(np.int64)

    @staticmethod
    def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys["one"] ^ mix(keys["two"] + np.uint64((level + 1) * STEP % (1 << 64)))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels: list[np.ndarray] = []
        while len(keys):
            bits = BITS_PER_KEY * len(keys) + 6 & ~7 or 8
            at = cls._bit(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for some keys that are none of the set; others of these get any place."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._bit(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level] + ranks[at[hit]] - 1
            left = left[~hit]
        return out

    def packed(self) -> tuple[bytes, bytes]:
        """Sizes of the levels, and their bits."""
        return np.array([len(x) for x in self.levels], "<u4").tobytes(), b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, "<u4").tolist():
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        return cls(levels)


class LineCounts:
    """The lines of a shard: a perfect hash and, by place, fingerprint, number of documents (up to 2^32-1), and for lines of
    at least ``min_docs`` documents the largest of these (``known`` is 0 for one without an id)."""

    FIELDS = ("sizes", "bits", "fingerprint", "docs", "known", "largest")
    SCHEMA = ", ".join(f"{f} binary" for f in FIELDS)

    def __init__(self, sizes: bytes, bits: bytes, fingerprint: bytes, docs: bytes, known: bytes, largest: bytes):
        self.hash = PerfectHash.unpacked(sizes, bits)
        self.fingerprint, self.docs = np.frombuffer(fingerprint, "<u4"), np.frombuffer(docs, "<u4")
        self.known, self.largest = np.frombuffer(known, "u1"), np.frombuffer(largest, "<i8")

    @staticmethod
    def built(keys: np.ndarray, docs: np.ndarray, known: np.ndarray, largest: np.ndarray, min_docs: int) -> tuple[bytes, ...]:
        """Arrays of distinct lines as bytes, in the order of FIELDS."""
        hash_ = PerfectHash.of(keys)
        order = np.argsort(hash_.place(keys))
        common = order[docs[order] >= min_docs]
        prints = (keys["two"][order] & np.uint64(0xFFFFFFFF)).astype("<u4")
        return (*hash_.packed(), prints.tobytes(), np.minimum(docs[order], 0xFFFFFFFF).astype("<u4").tobytes(), known[common].astype("u1").tobytes(), largest[common].astype("<i8").tobytes())

    def common(self, keys: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``keys`` that stand in at least ``min_docs`` documents, and the largest of these."""
        place = self.hash.place(keys)
        here = np.flatnonzero(place >= 0)
        place = place[here]
        sure = (self.fingerprint[place] == (keys["two"][here] & np.uint64(0xFFFFFFFF)).astype("<u4")) & (self.docs[place] >= min_docs)
        here, place = here[sure], place[sure]
        nth = (np.cumsum(self.docs >= min_docs) - 1)[place]
        return here, self.known[nth], self.largest[nth]


def _keys(one: pa.ChunkedArray, two: pa.ChunkedArray) -> np.ndarray:
    keys = np.zeros(len(one), HASH)
    keys["one"], keys["two"] = one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64)
    return keys


#: What a chunk is told of a common line: its largest document.
ANSWER = np.dtype([("hash", HASH), ("known", "u1"), ("largest", "<i8")])


def _answers(keys: np.ndarray, known: np.ndarray, largest: np.ndarray) -> bytes:
    out = np.zeros(len(keys), ANSWER)
    out["hash"], out["known"], out["largest"] = keys, known, largest
    return out.tobytes()


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
    chunk_bytes: int = 4 << 20, shard_lines: int = 1 << 17, head_lines: int = 1 << 16,
) -> DataFrame:
    """Drop the lines whose key (the line without white space at its ends, A-Z lowered) has at least ``min_chars`` code
    points and stands in at least ``min_docs`` documents, except in the document of the largest id that holds it.

    Distinct lines of each document are counted by their 128-bit hash; of every ``shard_lines`` distinct lines, about, a
    task makes the arrays of a shard. Texts are dealt once into chunks of about ``chunk_bytes``. A chunk asks each shard for
    its distinct lines and is told the common ones. A line of many documents is asked for by many chunks, so the
    ``head_lines`` most frequent lines, under 20 bytes each, go to all chunks beforehand and are not asked for.

    Returns the columns of ``docs``, with the remaining lines, joined by ``\\n``, as ``text_col``, and ``n_lines`` (before
    dropping) and ``n_dropped``.

    Defined cases: a null text stays null and an empty one empty, each with one line; a text of which all lines go is
    empty; rows that repeat an id are one document when lines are counted and kept; ids are integers; rows without an
    id come before all others, in the order of a hash of their text, and those of equal texts are one document; repeats of
    a line in one document count once and all go or all stay; a table without long lines is returned as it is; an empty
    table gives an empty table; input columns called ``n_lines`` or ``n_dropped`` are replaced, all others are kept, whatever their
    names and types. Lines are told apart by 128 bits of BLAKE2, texts are never cut.
    """
    new = ("n_lines", "n_dropped")
    names = [c for c in docs.columns if c not in new]
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text_col}`")), F.lit(0))).first()[0]
    chunks = int(max(1, -(-total // chunk_bytes)))
    text, number = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    keyed = docs.select(
        text.cast("binary").alias("text"), number.isNotNull().cast("int").alias("known"), F.coalesce(number, F.xxhash64(text)).alias("id"),
        F.struct(*others).alias("row"), F.pmod(F.xxhash64(number, text), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [sorted(set(line_hashes(t or b"", min_chars)) - {b""}) for t in batch["text"].to_pylist()]
            keys = np.frombuffer(b"".join(h for own in hashes for h in own), HASH)
            of = np.repeat(np.arange(len(hashes)), [len(own) for own in hashes])
            columns = [np.ascontiguousarray(keys["one"]).view(np.int64), np.ascontiguousarray(keys["two"]).view(np.int64), batch["known"].to_numpy()[of], batch["id"].to_numpy()[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "known", "id"])

    lines = keyed.select("text", "known", "id").mapInArrow(find, "one long, two long, known int, id long")
    per_line = lines.distinct().groupBy("one", "two").agg(F.count("*").alias("docs"), F.max(F.struct("known", "id")).alias("last"))
    counts = written(per_line.select("one", "two", "docs", F.col("last.known").alias("known"), F.col("last.id").alias("largest")), "lines")
    shards = int(max(1, -(-counts.count() // shard_lines)))

    def arrays(table: pa.Table) -> tuple[bytes, ...]:
        docs_, known, largest = (table[c].to_numpy() for c in ("docs", "known", "largest"))
        return LineCounts.built(_keys(table["one"], table["two"]), docs_, known, largest, min_docs)

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32())} | {f: [b] for f, b in zip(LineCounts.FIELDS, arrays(table), strict=True)})

    # a line that one chunk in sixteen asks for is worth sending to all
    often = counts.filter(F.col("docs") >= max(min_docs, chunks // 16)).orderBy(F.desc("docs"), "one", "two").limit(head_lines)
    head = docs.sparkSession.sparkContext.broadcast(arrays(often.toArrow()))

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (keys["one"] % np.uint64(shards)).astype(np.int64)

    # unsigned remainder, as in shard_of()
    high = F.shiftrightunsigned("one", 1)
    shard = F.pmod(F.pmod(high, F.lit(shards)) * 2 + F.col("one").bitwiseAND(F.lit(1).cast("long")), F.lit(shards)).cast("int")
    index = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, f"shard int, {LineCounts.SCHEMA}")

    def chunk_keys(table: pa.Table) -> tuple[list[list[bytes]], np.ndarray]:
        hashes = [line_hashes(t or b"", min_chars) for t in table["text"].to_pylist()]
        return hashes, np.frombuffer(b"".join(sorted({h for own in hashes for h in own} - {b""})), HASH)

    def ask(table: pa.Table) -> pa.Table:
        keys = chunk_keys(table)[1]
        keys = np.delete(keys, LineCounts(*head.value).common(keys, min_docs)[0])
        keys = keys[np.argsort(shard_of(keys), kind="stable")]
        to, first = np.unique(shard_of(keys), return_index=True)
        blobs = [part.tobytes() for part in np.split(keys, first[1:])] if len(keys) else []
        return pa.table({"shard": pa.array(to, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(to), pa.int32()), "data": pa.array(blobs, pa.binary())})

    def answer(asked: pa.Table, shard_: pa.Table) -> pa.Table:
        chunk, data = [], []
        if asked.num_rows and shard_.num_rows:
            held = LineCounts(*(shard_[f][0].as_py() for f in LineCounts.FIELDS))
            for c, blob in zip(asked["chunk"].to_pylist(), asked["data"].to_pylist(), strict=True):
                keys = np.frombuffer(blob, HASH)
                rows, known, largest = held.common(keys, min_docs)
                if len(rows):
                    chunk.append(c)
                    data.append(_answers(keys[rows], known, largest))
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "data": pa.array(data, pa.binary())})

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        hashes, keys = chunk_keys(table)
        rows, known, largest = LineCounts(*head.value).common(keys, min_docs)
        answers = np.frombuffer(b"".join([_answers(keys[rows], known, largest), *(told["data"].to_pylist() if told.num_rows else [])]), ANSWER)
        packed, keepers = answers["hash"].tobytes(), zip(answers["known"].tolist(), answers["largest"].tolist(), strict=True)
        stays = {packed[k : k + 16]: keeper for k, keeper in zip(range(0, len(packed), 16), keepers, strict=True)}
        kept, n_lines, n_dropped = [], [], []
        for raw, own, me in zip(table["text"].to_pylist(), hashes, zip(table["known"].to_pylist(), table["id"].to_pylist(), strict=True), strict=True):
            go = [stays.get(h, me) != me for h in own]
            n_lines.append(len(own))
            n_dropped.append(sum(go))
            kept.append(b"\n".join(line for line, gone in zip(raw.split(b"\n"), go, strict=True) if not gone) if any(go) else raw)
        return pa.table({"row": table["row"], "text": pa.array(kept, pa.binary()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    asked = keyed.groupBy("chunk").applyInArrow(ask, "shard int, chunk int, data binary")
    told = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "chunk int, data binary")
    schema = StructType([keyed.schema["row"], keyed.schema["text"], *(StructField(c, LongType()) for c in new)])
    done = keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, schema)

    def back(c: str) -> Column:
        return F.col("text").cast("string") if c == text_col else F.col("row").getField(c)

    return done.select(*[back(c).alias(c) for c in names], *new)
