"""Removal of repeated byte strings across documents by a hash-compared suffix sort.

Every window of WINDOW bytes has an anchor, the ANCHOR-byte string in it with the least hash. Equal windows have equal
anchors at equal places, so only windows of one anchor need to be compared, wherever they are. A run of windows with
one anchor is a fragment. Of an anchor that occurs more than once the texts of all fragments are fetched: fragments that are
equal byte by byte are settled as a whole, and the windows of different ones are sorted as suffixes. Where an anchor has
very many fragments, each window is a fragment of its own with its own hash for an anchor. Hashes only bring together
what may be equal; nothing is removed whose bytes were not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from speechjobs.llm.common import written
from speechjobs.llm.hashing import PrefixHashes, PrimeHashes, mix, runs_of, sliced

WINDOW, ANCHOR = 100, 32
#: Bytes of text whose fragments are worked out at once, and for which they are gathered before they are sent.
WORK_BYTES, FLUSH_BYTES = 1 << 20, 8 << 20
#: Bytes of fragments that are sorted at once; a larger anchor is one piece of work.
SORT_BYTES = 2 << 20
REMOVE, COMPARE = 0, 1
#: Fragments that one anchor may have, about, before its windows go apart; slots of counters for each chunk of text, and in all.
HOT, SLOTS, MOST_SLOTS = 8192, 64, 1 << 20
#: Bits of an anchor's hash that choose it, over the place of the anchor: the same for every length of text.
PLACE_BITS = np.uint64(32)
#: Columns of what tasks send each other, in this order, one after the other in a binary value. A document is known by
#: ``id`` and a hash ``tie`` of its text, for ids that repeat.
DOC = [("id", "i8"), ("tie", "i8"), ("chunk", "i4"), ("start", "u4"), ("n", "u4")]
FRAGMENT = [*DOC, ("off", "u1"), ("anchor", "u4")]


def _pack(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]], rows: np.ndarray) -> bytes:
    return b"".join(columns[name][rows].astype(kind).tobytes() for name, kind in kinds)


def _unpack(blobs: list[bytes], kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(k).itemsize for _, k in kinds)
    parts: dict[str, list] = {name: [] for name, _ in kinds}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in kinds:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(parts[name]) if blobs else np.zeros(0, kind) for name, kind in kinds}


def _split(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]], by: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows for each value of ``by``."""
    order = np.argsort(by, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(by[order])) + 1) if len(order) else ():
        yield int(by[rows[0]]), _pack(columns, kinds, rows)


def text_hash(text: Column) -> Column:
    """Tells texts of one id, or without an id, apart."""
    return F.xxhash64(text)


def slot_of(anchor: np.ndarray, slots: int) -> np.ndarray:
    """The counter of each anchor."""
    return ((anchor >> np.uint64(16)) % np.uint64(slots)).astype(np.int64)


def fragments(raw: list[bytes], hot: np.ndarray | None = None, slots: int = 1) -> dict[str, np.ndarray]:
    """All fragments of some texts: ``doc`` (number of the text), ``start`` and ``n`` (its windows), ``off`` (of the
    anchor from the start), ``anchor`` and ``frag`` (hashes) and ``at`` (place in all texts, one after the other). In ``hot``
    slots each window is a fragment, and a hash of the window stands for the anchor."""
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(raw)), np.maximum(sizes - WINDOW + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes - WINDOW + 1, 0))])
    starts = np.arange(len(doc)) - first[doc] + bounds[doc]
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "off", "at")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "frag")}
    hashes = PrefixHashes(data)
    grams = mix(hashes.of(np.arange(len(data) - ANCHOR + 1), ANCHOR))
    least = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    at = (least[starts] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    begin, n = starts[head], np.diff(head, append=len(starts))
    at, doc = at[head], doc[head]
    apart = np.isin(slot_of(grams[at], slots), hot) if hot is not None and len(hot) else np.zeros(len(at), bool)
    if apart.any():
        parts = np.where(apart, n, 1)
        of = np.repeat(np.arange(len(n)), parts)
        begin = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, doc, apart = at[of], doc[of], apart[of]
        n = np.where(apart, 1, n[of])
    frag = mix(hashes.of(begin, n + WINDOW - 1) + ((at - begin) * 256 + n).astype(np.uint64))
    # windows that go apart meet by their own hash, at place 0
    off = np.where(apart, 0, at - begin)
    return {"doc": doc, "start": begin - bounds[doc], "n": n, "off": off, "anchor": np.where(apart, mix(frag), grams[at]), "frag": frag, "at": begin}


def _first_of(keys: list[np.ndarray], order_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are the first of their keys by ``order_by``; the rest; and the first row of each of the rest. Rows that are
    equal in everything come from repeated rows of the table and are one."""
    order = np.lexsort([*reversed(order_by), *reversed(keys)])
    head, new = np.zeros(len(order), bool), np.zeros(len(order), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[order][1:] != k[order][:-1]
    for k in order_by:
        new[1:] |= k[order][1:] != k[order][:-1]
    again = ~head & new
    leads = order[head][np.cumsum(head) - 1] if len(order) else order
    return order[head], order[again], leads[again]


def equal_fragments(found: dict[str, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the first fragment, by document and start, of each anchor, place and text, and the rest, which repeat one.
    The texts themselves are compared."""
    first: dict[tuple, int] = {}
    again, facts = [], list(zip(*(found[k].tolist() for k in ("id", "tie", "chunk", "start")), strict=True))
    order = sorted(range(len(texts)), key=facts.__getitem__)
    for r, anchor, off in zip(order, found["anchor"][order].tolist(), found["off"][order].tolist(), strict=True):
        lead = first.setdefault((anchor, off, texts[r]), r)
        if facts[lead] != facts[r]:
            again.append(r)
    return np.array(list(first.values()), np.int64), np.array(again, np.int64)


def merge_sort(hashes: PrimeHashes, data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes (places in ``data``, compared up to ``length`` bytes) within groups; ``group`` must be rising.

    Bottom-up merge sort of all groups side by side. Two suffixes are compared by their longest common extension, which
    a binary search over prefix hashes finds in log2(length) steps. Returns the order, and for each sorted row whether it
    equals the row before.
    """

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
        while len(a) and (low < high).any():
            mid = (low + high + 1) // 2
            same = hashes.of(a, mid) == hashes.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = common(a, b)
        equal = n >= length
        n = np.minimum(n, length - 1)
        return np.where(equal, or_equal, data[a + n] < data[b + n])

    head = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(head, append=len(group))
    base, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
    order = np.arange(len(suffix))
    width = 1
    while width < (sizes.max() if len(sizes) else 0):
        rows = np.flatnonzero(size > width)
        rank = rows - base[rows]
        run = rank // width
        left = run % 2 == 0
        # the run that each row's run is merged with
        other = np.where(left, (run + 1) * width, (run - 1) * width)
        other_end = np.minimum(other + width, size[rows])
        low, high = other.copy(), np.maximum(other_end, other)
        mine = suffix[order[rows]]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            goes_first = before(suffix[order[base[rows[open_]] + mid]], mine[open_], ~left[open_])
            low[open_] = np.where(goes_first, mid + 1, low[open_])
            high[open_] = np.where(goes_first, high[open_], mid)
        pair = (run // 2) * 2 * width
        to = base[rows] + pair + (rank - run * width) + (low - other)
        merged = order.copy()
        merged[to] = order[rows]
        order = merged
        width *= 2
    equal = np.zeros(len(order), bool)
    rest = np.flatnonzero(group[1:] == group[:-1]) + 1
    equal[rest] = common(suffix[order[rest - 1]], suffix[order[rest]]) >= length
    return order, equal


def verified(data: np.ndarray, suffix: np.ndarray, order: np.ndarray, group: np.ndarray, length: int, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Compare the bytes of all neighbours of a sort: whether each row equals the row before in its group, and the groups in
    which two rows are in the wrong order, because hashes collided."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    equal, wrong = np.zeros(len(order), bool), []
    neighbours = np.flatnonzero(group[1:] == group[:-1]) + 1
    for k in range(0, len(neighbours), at_once):
        rows = neighbours[k : k + at_once]
        one, two = windows[suffix[order[rows - 1]]], windows[suffix[order[rows]]]
        differs = one != two
        at, apart = differs.argmax(1), differs.any(1)
        here = np.arange(len(rows))
        right = np.where(apart, one[here, at] < two[here, at], order[rows - 1] < order[rows])
        equal[rows] = ~apart
        wrong.append(group[rows[~right]])
    return equal, np.unique(np.concatenate(wrong)) if wrong else np.zeros(0, np.int64)


def repeated_windows(found: dict[str, np.ndarray], texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows of fragments of some anchors that an earlier fragment also has, as columns of DOC."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    n = found["n"].astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    shift = i - found["off"].astype(np.int64)[of]
    # a window's group: its anchor and its place around it; members in the order of documents
    by = np.lexsort((found["start"][of], found["tie"][of], found["id"][of], shift, found["anchor"][of]))
    of, i, shift, anchor = of[by], i[by], shift[by], found["anchor"][of][by]
    group = np.cumsum((np.diff(anchor.astype(np.int64), prepend=-1) != 0) | (np.diff(shift, prepend=-1000) != 0))
    size = np.bincount(group)
    several = size[group] > 1
    of, i, group = of[several], i[several], group[several]
    suffix = place[of] + i
    order, _ = merge_sort(PrimeHashes(data), data, suffix, group, WINDOW)
    equal, wrong = verified(data, suffix, order, group, WINDOW)
    for g in wrong:  # hashes that collided: the group is sorted by its bytes
        mine = np.flatnonzero(group == g)
        text = [data[s : s + WINDOW].tobytes() for s in suffix[mine].tolist()]
        exact = sorted(range(len(mine)), key=text.__getitem__)
        order[mine] = mine[exact]
        equal[mine] = [k > 0 and text[exact[k]] == text[exact[k - 1]] for k in range(len(mine))]
    # sorting is stable, so the first of equal windows is the first by document and start
    gone = np.sort(suffix[order[equal]])
    owner = np.searchsorted(place, gone, "right") - 1
    head = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    which = owner[head]
    return {k: found[k][which] for k in ("id", "tie", "chunk")} | {"start": found["start"][which] + gone[head] - place[which], "n": np.diff(head, append=len(gone))}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, hot_fragments: int = HOT) -> DataFrame:
    """Remove from every whole text, as UTF-8 bytes, each byte covered by a string of WINDOW bytes that also starts
    earlier: in a document with a smaller id, or earlier in the same document. Strings are judged on the input.

    Tasks find the fragments of their texts, settle among themselves those that are equal byte by byte, and send the rest,
    packed, to the bucket of the anchor. Of anchors that come more than once, buckets fetch the texts, settle equal
    fragments and sort the windows of different ones. What is to go returns to the chunks of documents, where it is cut
    out. Copies of any number cost a task one fragment, so no bucket grows with a group of copies. A first pass counts the
    fragments of anchors, by slots; in slots of more than ``hot_fragments`` all windows go to buckets of their own hash, so
    no bucket grows with the surroundings of a common line. The texts are shuffled once, for fetching and cutting.

    Returns the columns of ``docs`` with ``kept`` (binary: the remaining bytes), ``kept_text`` (the same as a string,
    without characters of which a part is gone), ``n_bytes``, ``n_removed`` and ``n_spans``
    (maximal removed runs).

    Defined cases: null is empty; texts under WINDOW bytes stay whole; rows that repeat id and text are one document:
    each gets its result; rows that repeat an id with other texts are ordered by a hash of the text; rows without
    an id come after all others, in the order of that hash; ids are integers; an empty table gives an empty table;
    columns that are called like the new ones are replaced, all others are kept, whatever their names and types.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks = int(max(1, -(-total // chunk_bytes)))
    last = (1 << 63) - 1
    new_types = {"kept": BinaryType(), "kept_text": StringType(), "n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType()}
    names = [c for c in docs.columns if c not in new_types]
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    body = F.col(f"`{text_col}`")
    tie = text_hash(F.coalesce(body, F.lit("")))
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(last))
    # the other columns as one, so that their names cannot clash
    keyed = docs.select(F.struct(*(others or [F.lit(0)])).alias("row"), body.alias("text"), number.alias("id"), tie.alias("tie"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("id", F.when(F.col("id") == last, F.col("tie"))), F.lit(chunks)).cast("int"))
    slots = min(SLOTS * chunks, MOST_SLOTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(slots, np.int64), [], 0

        def add() -> None:
            frag, slot = (np.concatenate(x) for x in zip(*held, strict=True))
            np.add.at(counts, slot[np.unique(frag, return_index=True)[1]], 1)

        for batch in sliced(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            for rows in runs_of(np.array([len(r) for r in raw]), WORK_BYTES):
                found = fragments([raw[r] for r in rows])
                held.append((found["frag"], slot_of(found["anchor"], slots)))
                size += int(found["n"].sum())
                if size >= FLUSH_BYTES:
                    add()
                    held, size = [], 0
        if held:
            add()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": some, "n": counts[some]})

    text = keyed.select("text", "id", "tie", "chunk")
    counted = written(text.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    # where slots have many anchors each, those that stand out; they are a quarter of all at most
    mean = (counted.agg(F.sum("n")).first()[0] or 0) // slots
    crowded = counted.filter(F.col("n") > max(hot_fragments, 4 * mean)).collect()
    hot = np.array(sorted(r["slot"] for r in crowded), np.int64)
    # as many more buckets as windows that go apart fill
    buckets = chunks + sum(r["n"] for r in crowded) * (WINDOW - ANCHOR + 1) // (1 << 20)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[dict], blocks: list[bytes]) -> pa.RecordBatch:
            f = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            bucket = (f["anchor"] >> np.uint64(32)).astype(np.int64) % buckets
            f["anchor"] = f["anchor"] & np.uint64(0xFFFFFFFF)
            own, again, lead = _first_of([bucket, f["anchor"], f["off"], f["frag"]], [f["id"], f["tie"], f["chunk"], f["start"]])
            block, begin, end = f["block"].tolist(), f["at"].tolist(), (f["at"] + f["n"] + WINDOW - 1).tolist()
            same = np.array([blocks[block[r]][begin[r] : end[r]] == blocks[block[x]][begin[x] : end[x]] for r, x in zip(again.tolist(), lead.tolist(), strict=True)], bool)
            own = np.concatenate([own, again[~same]])  # hashes that collided
            rows = [(b, COMPARE, b, blob) for b, blob in _split({k: v[own] for k, v in f.items()}, FRAGMENT, bucket[own])]
            gone = _joined({k: f[k][again[same]] for k, _ in DOC})
            rows += [(c, REMOVE, c, blob) for c, blob in _split(gone, DOC, gone["chunk"])]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["at", "kind", "chunk", "data"])

        held, blocks, size = [], [], 0
        for batch in sliced(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            facts = {k: batch[k].to_numpy() for k in ("id", "tie", "chunk")}
            for rows in runs_of(np.array([len(r) for r in raw]), WORK_BYTES):
                found = fragments([raw[r] for r in rows], hot, slots)
                if len(found["doc"]):
                    owner = rows[found.pop("doc")]
                    held.append(found | {k: v[owner] for k, v in facts.items()} | {"block": np.full(len(owner), len(blocks))})
                    blocks.append(b"".join(raw[r] for r in rows))
                    size += max(int(found["n"].sum()), 8 * len(owner))
                if size >= FLUSH_BYTES:
                    yield send(held, blocks)
                    held, blocks, size = [], [], 0
        if held:
            yield send(held, blocks)

    def settle(table: pa.Table) -> pa.Table:
        """Asks for the texts of anchors that more than one fragment has."""
        kind, data = table["kind"].to_pylist(), table["data"].to_pylist()
        out = [(c, REMOVE, -1, d) for c, k, d in zip(table["chunk"].to_pylist(), kind, data, strict=True) if k == REMOVE]
        f = _unpack([d for d, k in zip(data, kind, strict=True) if k == COMPARE], FRAGMENT)
        if len(f["id"]):
            bucket = table["at"][0].as_py()
            order = np.lexsort((f["start"], f["tie"], f["id"], f["anchor"]))
            new = np.ones(len(order), bool)  # rows that repeat in the table are one
            new[1:] = np.any([f[k][order][1:] != f[k][order][:-1] for k in ("anchor", "id", "tie", "start")], 0)
            rows = order[new]
            _, which, several = np.unique(f["anchor"][rows], return_inverse=True, return_counts=True)
            ask = {k: f[k][rows[several[which] > 1]] for k, _ in FRAGMENT}
            out += [(c, COMPARE, bucket, blob) for c, blob in _split(ask, FRAGMENT, ask["chunk"])]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "kind", "bucket", "data"])

    def fetch(texts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            raw = {(i, t): (x or "").encode("utf-8", "surrogatepass") for i, t, x in zip(*(texts[k].to_pylist() for k in ("id", "tie", "text")), strict=True)}
            for bucket, blob in zip(asked["bucket"].to_pylist(), asked["data"].to_pylist(), strict=True):
                f = _unpack([blob], FRAGMENT)
                cut = [raw[i, t][s : s + n + WINDOW - 1] for i, t, s, n in zip(*(f[k].tolist() for k in ("id", "tie", "start", "n")), strict=True)]
                out.append((bucket, blob, b"".join(cut)))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "data", "text"])

    def sort(table: pa.Table) -> pa.Table:
        f = _unpack(table["data"].to_pylist(), FRAGMENT)
        both = b"".join(table["text"].to_pylist())
        lengths = f["n"].astype(np.int64) + WINDOW - 1
        ends = np.cumsum(lengths)
        # whole anchors at a time, so that memory holds
        by = np.argsort(f["anchor"], kind="stable")
        head = np.flatnonzero(np.diff(f["anchor"][by].astype(np.int64), prepend=-1))
        edges = np.append(head, len(by))
        out = []
        for part in runs_of(np.add.reduceat(lengths[by], head) if len(by) else by, SORT_BYTES):
            rows = by[edges[part[0]] : edges[part[-1] + 1]]
            texts = [both[b - n : b] for b, n in zip(ends[rows].tolist(), lengths[rows].tolist(), strict=True)]
            own = {k: v[rows] for k, v in f.items()}
            firsts, again = equal_fragments(own, texts)
            gone = _joined({k: own[k][again] for k, _ in DOC})
            out += _split(gone, DOC, gone["chunk"])
            _, which, several = np.unique(own["anchor"][firsts], return_inverse=True, return_counts=True)
            firsts = firsts[several[which] > 1]
            if len(firsts):
                gone = repeated_windows({k: v[firsts] for k, v in own.items()}, [texts[r] for r in firsts.tolist()])
                out += _split(gone, DOC, gone["chunk"])
        columns = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["chunk", "data"])

    def cut(texts: pa.Table, removed: pa.Table) -> pa.Table:
        f = _unpack(removed["data"].to_pylist() if removed.num_rows else [], DOC)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts["text"].to_pylist()]
        order = np.lexsort((f["tie"], f["id"]))
        keys = list(zip(f["id"][order].tolist(), f["tie"][order].tolist(), strict=True))
        start, end = f["start"].astype(np.int64)[order], (f["start"].astype(np.int64) + f["n"] + WINDOW - 1)[order]
        spans: dict[tuple, list[int]] = {}
        for at, key in enumerate(keys):
            spans.setdefault(key, [at, at])[1] = at + 1
        kept, counts, runs = [], [], []
        for r, key in zip(raw, zip(texts["id"].to_pylist(), texts["tie"].to_pylist(), strict=True), strict=True):
            a, b = spans.get(key, (0, 0))
            step = np.zeros(len(r) + 1, np.int64)
            np.add.at(step, start[a:b], 1)
            np.add.at(step, end[a:b], -1)
            covered = np.cumsum(step[:-1]) > 0 if b > a else np.zeros(len(r), bool)
            kept.append(np.frombuffer(r, np.uint8)[~covered].tobytes() if b > a else r)
            counts.append(int(covered.sum()))
            runs.append(int((np.diff(covered, prepend=False) & covered).sum()))
        new = {"kept": pa.array(kept, pa.binary()), "kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "n_removed": pa.array(counts, pa.int64()), "n_spans": pa.array(runs, pa.int64())}
        return pa.table({c: texts[c] for c in ("row", "text")} | new)

    settled = written(text.mapInArrow(find, "at int, kind int, chunk int, data binary").groupBy("at").applyInArrow(settle, "chunk int, kind int, bucket int, data binary"), "settled")
    asked = settled.filter(F.col("kind") == COMPARE)
    # the same columns as for cutting below, so that both read one shuffle of the texts
    sorted_ = keyed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(fetch, "bucket int, data binary, text binary").groupBy("bucket").applyInArrow(sort, "chunk int, data binary")
    removed = settled.filter(F.col("kind") == REMOVE).select("chunk", "data").union(sorted_)
    schema = StructType([keyed.schema["row"], keyed.schema["text"], *(StructField(c, t) for c, t in new_types.items())])
    done = keyed.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(cut, schema)
    return done.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names], *new_types)


def _joined(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns of DOC with runs that touch or overlap put together."""
    order = np.lexsort((f["start"], f["tie"], f["id"]))
    f = {k: f[k][order] for k, _ in DOC}
    if not len(order):
        return f
    start = f["start"].astype(np.int64)
    end = start + f["n"]
    same = (f["id"][1:] == f["id"][:-1]) & (f["tie"][1:] == f["tie"][:-1])
    head = np.concatenate([[True], ~(same & (start[1:] <= end[:-1]))])
    at = np.flatnonzero(head)
    last = np.maximum.reduceat(end, at)
    return {k: f[k][at] for k in ("id", "tie", "chunk", "start")} | {"n": last - start[at]}


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Figures of remove_repeats() with the SHA-256 of the remaining bytes."""
    return df.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
