"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from speechjobs.llm.common import discard, written
from speechjobs.llm.hashing import distinct, mix, runs_of, sliced, token_hashes, tokens

#: Words in a shingle, and the least similarity of a link in percent.
WORDS, PERCENT = 5, 75
#: A pair at exactly 75 % shares no band with probability (1 - 0.75^ROWS)^BANDS = 5e-6.
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
#: Signature values are compared in batches of this many.
BATCH = 16
#: A candidate is dropped once the posterior probability of a similarity of 75 % or more is below this.
MISS = 1e-6
#: Members of a bucket are compared in blocks of this many.
BLOCK = 512
WORK_BYTES = 1 << 20
#: Rows of one set of shingles are spread over groups of about this many.
ROWS_PER_SALT = 20_000
#: Integer ids compare as unsigned numbers once this bit is flipped.
SIGN = -(1 << 63)

_random = np.random.default_rng(20240101)
MULTIPLIERS = _random.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
PLACES = _random.integers(1, 1 << 63, max(WORDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word shingles; one for a text of fewer words."""
    for rows in runs_of(np.array([len(t or "") for t in texts]), WORK_BYTES):
        data, start, end, doc = tokens([texts[i] or "" for i in rows])
        words = token_hashes(data, start, end)
        bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
        n = max(0, len(words) - WORDS + 1)
        full = mix(sum((words[i : i + n] * PLACES[i] for i in range(WORDS)), np.zeros(n, np.uint64)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield distinct(full[a : b - WORDS + 1])
            elif b > a:
                yield mix((words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SIGNATURE minima of 32 bits of a set that is not empty."""
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[i : i + 1024, None] * MULTIPLIERS + OFFSETS) >> np.uint64(32)).min(0))
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """BANDS bucket numbers; the band's own number is part of the hash."""
    return mix((low.reshape(BANDS, ROWS) * PLACES[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out: tuple[list, ...] = ([], [], [], [])
        for hashes in shingle_sets(batch["text"].to_pylist()):
            low = signature(hashes) if len(hashes) else None
            for column, value in zip(out, (len(hashes), blake2b(hashes.tobytes(), digest_size=16).digest(), low if low is None else bands(low), low if low is None else low.astype(np.uint16).tobytes()), strict=True):
                column.append(value)
        known = {c: batch[c] for c in ("number", "tie", "row", "seed")}
        yield pa.RecordBatch.from_pydict(known | {"n": pa.array(out[0], pa.int64()), "digest": pa.array(out[1], pa.binary()), "bands": pa.array(out[2], pa.list_(pa.int64())), "signature": pa.array(out[3], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield pa.RecordBatch.from_pydict({"node": batch["node"], "hashes": pa.array((h.tobytes() for h in shingle_sets(batch["text"].to_pylist())), pa.binary())})


def encode_id(number: Column, kind: DataType) -> Column:
    """An id as bytes that sort as the ids do: integers by value, all others by their text. Null stays null."""
    if isinstance(kind, IntegralType):
        body = F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(SIGN))), 16, "0"))
    else:
        body = F.encode(number.cast("string"), "UTF-8")
    return F.concat(F.lit(b"\x00"), body)


def decode_id(node: Column, kind: DataType) -> Column:
    """The id that encode_id() made bytes of; null for nodes without one."""
    body = F.substring(node, 2, 1 << 30)
    if isinstance(kind, IntegralType):
        value = F.conv(F.hex(body), 16, -10).cast("long").bitwiseXOR(F.lit(SIGN)).cast(kind)
    else:
        value = F.decode(body, "UTF-8").cast(kind)
    return F.when(F.substring(node, 1, 1) == F.lit(b"\x00"), value)


def least_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest equal values among ``compared`` with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n equal) is the probability that n + 1 throws of chance t hit m
    times at most.
    """
    t = percent / 100
    below = 0.0
    for m in range(compared + 1):
        below += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if below >= miss:
            return m
    return compared


LIMITS = [least_matches(n) for n in range(BATCH, SIGNATURE + 1, BATCH)]


def bayes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal signature values of each pair of rows; -1 where the pair was dropped. Batch after batch, only pairs that
    still may reach the similarity are compared further."""
    matches = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for k, least in enumerate(LIMITS):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
        low = matches[alive] < least
        matches[alive[low]] = -1
        alive = alive[~low]
    return matches


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            matches = bayes(_signatures(batch["one"]), _signatures(batch["two"]))
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "matches": matches}).filter(pa.array(matches >= 0))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets are linked."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = [similar(np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)) for one, two in zip(batch["one"], batch["two"], strict=True)]
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"]}).filter(pa.array(linked, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge list (a, b) can reach. Nodes are of any
    type that sorts; a null in an edge drops it, and an empty list gives an empty table.

    Alternating star operations: every node's larger neighbours are hung on its smallest neighbour, then its smaller
    ones, until nothing changes. Only minima are aggregated, so a node of any degree is spread over tasks. Each round's
    table replaces the one before.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("c")).agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        hung = large.join(least, F.col("a") == F.col("c"))
        small = hung.select("a", F.col("m").alias("b")).union(hung.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        last, edges = edges, written(small, "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _candidates(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that Bayesian verification leaves, with their equal signature values."""
    one, two = (signatures.select(F.col("node").alias(n), F.col("signature").alias(s)) for n, s in (("a", "one"), ("b", "two")))
    return written(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_prune, "a binary, b binary, matches long"), "candidates")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents connected by links of at least 75 % equal word shingles.

    1. Every text gives its shingle set, MinHash signature and band buckets; documents of one set become one node, named
       by the smallest id among them.
    2. Each bucket pairs its members with one of them, its hub: a star rather than all pairs. A group of many copies
       has different hubs in its many buckets, so few stars connect it. Signatures of these candidates are compared
       batch by batch and pairs are dropped by the posterior bound.
    3. What is left is confirmed on full shingle sets, and connected documents are put into groups.
    4. Buckets that still hold several groups have all their other pairs between groups tested in the same way, block
       against block within tasks, which give links only. So no link between different texts depends on which
       member was a bucket's hub; pairs within a group that is already connected need no test.

    Groups return to the rows by the set and a salt, so a set that a third of all rows have is spread over many tasks.

    Returns one row for each row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``,
    ``tie`` (xxhash64 of the text, which tells rows without an id apart), ``group`` (binary; null for an empty set).

    Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing; a text of
    fewer than five words is one shingle; repeated rows are linked; rows that repeat an id are one document with all
    their links; rows without an id belong to the group of their links, have no ``component_id`` when no member has
    an id, and are then kept; any integer is an id, and ids of other types go by their text; an empty table gives an
    empty table; further columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    number, tie = encode_id(F.col(id_col), kind), F.xxhash64(F.col(text_col))
    numbered = docs.select(number.alias("number"), F.col(text_col).alias("text"), tie.alias("tie"), F.xxhash64(F.lit("row"), number, tie).alias("row"))
    # written once, the seed stays what it is and tells even equal rows apart
    sketched = written(numbered.withColumn("seed", F.monotonically_increasing_id()).mapInArrow(_sketch, "number binary, tie long, row long, seed long, n long, digest binary, bands array<long>, signature binary"), "sketches")
    # one node for each set; any row of the set brings the signature, and later the text
    any_row = [F.first(c).alias(c) for c in ("bands", "signature", "row", "tie")]
    sets = sketched.filter("n > 0").groupBy("digest").agg(F.min("number").alias("number"), *any_row)
    own = written(sets.withColumn("node", F.coalesce("number", F.concat(F.lit(b"\xff"), F.col("digest")))).drop("number"), "nodes")
    # a bucket's hub is its member of the least hash with the bucket: buckets of the same members have different hubs
    keyed = own.select("node", F.posexplode("bands").alias("band", "key"))
    rank = F.struct(F.xxhash64("node", "key").alias("rank"), "node")
    hubs = keyed.groupBy("key").agg(F.min(rank)["node"].alias("hub"), F.count("*").alias("members")).filter("members > 1")
    shared = written(keyed.join(hubs, "key"), "buckets")
    star = shared.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    # texts are shuffled once, for the sets of all documents that share a bucket; the list of them grows with the corpus
    members = shared.select("node").distinct().join(own.select("node", "row", "tie"), "node").hint("merge")
    texts = numbered.groupBy("row", "tie").agg(F.first("text").alias("text"))
    hashes = written(texts.join(members, ["row", "tie"]).select("node", "text").mapInArrow(_sets, "node binary, hashes binary"), "sets")
    first = _confirmed(_candidates(star, own.select("node", "signature")), hashes)
    links = first.union(_between_groups(shared, components(first), own, hashes))
    groups = components(links)
    labels = own.select("digest", "node").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("group"))
    salts = -(-sketched.count() // ROWS_PER_SALT)
    salted = sketched.withColumn("salt", F.pmod(F.xxhash64("number", "seed"), F.lit(max(1, salts))))
    spread = salted.filter("n > 0").select("digest", "salt").distinct().join(labels, "digest")
    found = salted.select("number", "tie", "n", "digest", "salt").join(spread, ["digest", "salt"], "left")
    own_id, component = decode_id(F.col("number"), kind), F.when(F.col("group").isNull(), decode_id(F.col("number"), kind)).otherwise(decode_id(F.col("group"), kind))
    return found.select(own_id.alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(own_id == component, component.isNull()).alias("kept"), "tie", "group")


def _confirmed(waiting: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those of the candidates that are links on full sets."""
    one, two = (hashes.select(F.col("node").alias(n), F.col("hashes").alias(s)) for n, s in (("a", "one"), ("b", "two")))
    return written(waiting.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(_confirm, "a binary, b binary"), "links")


def _between_groups(shared: DataFrame, groups: DataFrame, own: DataFrame, hashes: DataFrame) -> DataFrame:
    """Links between bucket members of different groups; the pairs of each bucket's hub were tested before.

    A bucket's members fall into blocks by hash: a group of BLOCK members and more has blocks of its own, all others
    share blocks. Each pair of blocks that can hold a pair of different groups is one piece of work, so a bucket that is
    nearly one group sends its members to the few blocks of the others. Signatures go first; sets follow for the members
    of surviving pairs only. A pair is tested in the first bucket it shares, and not once its groups are connected.
    Members meet what is known of their bucket or group by a salt as well, one for each BLOCK members of the bucket.
    """
    salts = F.ceil(F.col("members") / BLOCK).cast("int")
    member = shared.filter("members > 2").join(groups, "node", "left").select(
        "key", "band", "node", "hub", "members", F.coalesce("component", "node").alias("group"), F.pmod(F.xxhash64("node", F.lit("salt")), salts).cast("int").alias("salt"),
    )
    bounds = member.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.first("members").alias("members"))
    mixed = bounds.filter("low < high").select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    open_ = member.filter("node <> hub").join(mixed, ["key", "salt"], "left_semi")
    # blocks of each bucket: first those of the large groups one after the other, then the shared ones
    sizes = open_.groupBy("key", "group").agg(F.count("*").alias("n"))
    large, blocks = F.col("n") >= BLOCK, F.ceil(F.col("n") / BLOCK).cast("int")
    order = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    alone = sizes.filter(large).select("key", "group", blocks.alias("blocks"), F.coalesce(F.sum(blocks).over(order), F.lit(0)).cast("int").alias("first"))
    totals = sizes.groupBy("key").agg(F.coalesce(F.sum(F.when(large, blocks)), F.lit(0)).cast("int").alias("pure"), F.ceil(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)) / BLOCK).cast("int").alias("rest"))
    places = sizes.join(alone, ["key", "group"], "left").join(totals, "key").select(
        "key", "group", F.coalesce("first", "pure").alias("first"), F.coalesce("blocks", "rest").alias("blocks"), F.col("blocks").isNotNull().alias("alone"), (F.col("pure") + F.col("rest")).alias("all"),
    )
    salted = open_.select("key", "group", "salt").distinct().join(places, ["key", "group"])
    dealt = open_.join(salted, ["key", "group", "salt"]).withColumn("mine", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: ~F.col("alone") | (b < F.col("first")) | (b >= F.col("first") + F.col("blocks")))
    placed = dealt.withColumn("other", F.explode(met)).select("key", "band", "node", "group", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    work = placed.join(own.select("node", "bands", "signature"), "node")

    def pairs_of(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the first block, rows of the second whose signatures agree and whose group was another one."""
        node, group, mine = (np.array(table[c].to_pylist(), object) for c in ("node", "group", "mine"))
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        keys, sig = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band], _signatures(table["signature"])
        columns = np.flatnonzero(mine == j)
        for r in np.flatnonzero(mine == i).tolist():
            with_ = columns[(group[columns] != group[r]) & ((node[columns] > node[r]) | (i != j))]
            with_ = with_[~(keys[with_] == keys[r]).any(1)]
            with_ = with_[bayes(np.broadcast_to(sig[r], (len(with_), SIGNATURE)), sig[with_]) >= 0]
            if len(with_):
                yield r, with_

    def survive(table: pa.Table) -> pa.Table:
        rows = sorted({x for r, with_ in pairs_of(table) for x in (r, *with_.tolist())})
        return table.take(pa.array(rows, pa.int64())).select(NEEDED)

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        node, group = table["node"].to_pylist(), np.array(table["group"].to_pylist(), object)
        out: list[tuple[bytes, bytes]] = []
        for r, with_ in pairs_of(table):
            for c in with_.tolist():
                if group[c] != group[r] and similar(sets[r], sets[c]):
                    out.append((min(node[r], node[c]), max(node[r], node[c])))
                    group[group == group[c]] = group[r]
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    NEEDED = ["key", "band", "node", "group", "mine", "i", "j", "bands", "signature"]
    left = written(work.groupBy("key", "i", "j").applyInArrow(survive, "key long, band int, node binary, group binary, mine int, i int, j int, bands array<long>, signature binary"), "survivors")
    return written(left.join(hashes, "node").groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary"), "more-links")
