"""Words that differ by one edit, found with an index of grams of variable length, and the spellings they stand for.

A gram dictionary holds the grams of the vocabulary, longer ones only where their beginning is frequent. A word is cut into
the longest grams of the dictionary that are not part of one another. One edit changes a bounded number of a word's
grams, so two near words share at least the rest, at the same place from the start or from the end. A word is
therefore looked up only in its rarest lists, one more than one edit can change. As all that stands on the other side of a shared
gram is equal too, a list is split by what stands there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechjobs.llm.common import discard, written
from speechjobs.llm.hashing import sliced

#: Runs of letters of Latin-1. Fixed pattern.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Ends of a word, which no run holds.
BEGIN, END = "^", "$"
SHORTEST, LONGEST = 2, 5
#: Distinct words of a task, and rows of lists, that are held before they are sent.
HELD, SENT = 200_000, 100_000
#: Words of a task that cuts them into grams.
WORDS = 20_000
#: Counters for the lengths of lists.
SLOTS = 1 << 20
#: Characters that are compared at once.
COMPARED = 1 << 22
SAME, LONGER = 0, 1
#: Of a word's grams of two characters, those that change where a character goes or is replaced, and where one comes.
PAIRS_CHANGED = (2, 1)


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None) -> DataFrame:
    """``word``, ``n``: the runs of letters of whole texts, A-Z lowered, of at least ``min_chars`` code points and with at
    least ``min_count`` occurrences.

    With ``typo_every`` a known share of the runs loses one character, which gives material with known spelling
    errors: where that number divides the CRC-32 h of ``<id>:<run>``, the character at h modulo the run's length goes.

    Defined cases: null and empty texts have no words; a null id is empty in the hash; rows that repeat count each; other
    columns take no part.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in sliced(batches, 100):
            for name, raw in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = Counter(RUN.findall((raw or b"").lower().decode("utf-8", "replace")))
                start = crc32(f"{name or ''}:".encode())
                for run, n in own.items():
                    if len(run) < min_chars:
                        continue
                    if typo_every and (h := crc32(run.encode(), start)) % typo_every == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < min_chars:
                            continue
                    counts[run] += n
                if len(counts) >= HELD:
                    yield send()
                    counts.clear()
        if counts:
            yield send()

    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(find, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class GramDictionary:
    """Grams of two characters, all of them, and the given longer ones; ``counts`` are the occurrences of grams in words.

    Longer grams must hold their beginnings of three and more characters.
    """

    def __init__(self, longer: set[str], counts: dict[str, int]):
        self.longer, self.counts = longer, counts
        self.longest = max(map(len, longer), default=SHORTEST)
        self.beginnings = {g[:k] for g in longer for k in range(SHORTEST, len(g))}
        self.endings = {g[k:] for g in longer for k in range(1, len(g) - SHORTEST + 1)}

    def grams(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each gram of a word with its ends: the longest at each place, without those inside another."""
        out, covered = [], 0
        for at in range(len(text) - 1):
            end = at + SHORTEST
            while end < len(text) and end - at < self.longest and text[at : end + 1] in self.longer:
                end += 1
            if end > covered:
                out.append((at, end))
                covered = end
        return out

    def changed(self, text: str, grams: list[tuple[int, int]]) -> tuple[int, int]:
        """The most grams that one edit of the word can change: by a character that goes or is replaced, and by one that comes.

        Of grams before the edit those may change that begin at or after a place from which a longer gram could now reach over
        the edit; of those after it, those that such a gram could now cover.
        """
        gone = come = first_near = 0
        for at in range(1, len(text)):
            while grams[first_near][0] <= at - self.longest:
                first_near += 1
            near = grams[first_near : first_near + 2 * self.longest]
            reach = [p for p in range(max(0, at - self.longest + 1), at - 1) if text[p:at] in self.beginnings] if self.longer else []
            before = sum(p >= reach[0] and e <= at for p, e in near) if reach else 0
            # a new character in front of this place, or this one gone or replaced
            come = max(come, before + sum(p < at < e or (p >= at and text[at:e] in self.endings) for p, e in near))
            if at < len(text) - 1:
                gone = max(gone, before + sum(p <= at < e or (p > at and text[at + 1 : e] in self.endings) for p, e in near))
        return gone, come

    def rarest(self, text: str, grams: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """In one order for all words: by occurrences, gram and place."""
        return sorted(grams, key=lambda g: (self.counts.get(text[g[0] : g[1]], 0), text[g[0] : g[1]], g[0]))


def lists_of(word: str, grams: GramDictionary, pairs: GramDictionary) -> set[tuple[int, int, int, int]]:
    """The lists a word is in: length of the shorter word with its ends, SAME or LONGER (partners of one length, or of
    this one and the next), and how many characters partners share at the start and at the end.

    Words of which one edit may change all grams are also cut into grams of two characters, of which it never does.
    """
    text = BEGIN + word + END
    out: set[tuple[int, int, int, int]] = set()
    own = grams.grams(text)
    changes = grams.changed(text, own)
    cut: list = []
    for kind, size, bound in ((SAME, len(text), 0), (LONGER, len(text), 1), (LONGER, len(text) - 1, 0)):
        looked_up = (cut := cut or grams.rarest(text, own))[: changes[bound] + 1]
        if changes[bound] >= len(own):
            looked_up = looked_up + pairs.rarest(text, pairs.grams(text))[: PAIRS_CHANGED[bound] + 1]
        for start, end in looked_up:
            for a, b in ((end, 0), (0, len(text) - start)):
                if a + b > size or (a + b == size and kind == SAME):
                    continue  # the edit would be outside of the word
                if 2 * (a + b) < size:  # too little for a list: one half of the word is equal, or the other
                    out |= {(size, kind, size // 2, 0), (size, kind, 0, size - size // 2)}
                else:
                    out.add((size, kind, a, b))
    return out


def gram_dictionary(words: DataFrame, list_words: int, most_grams: int) -> GramDictionary:
    """The dictionary of a vocabulary: a gram is made longer where it has more than ``list_words`` occurrences, or more than the
    least power of two times that with which the dictionary has at most ``most_grams`` longer grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for word in batch["word"].to_pylist():
                text = BEGIN + word + END
                counts.update(text[k : k + size] for size in range(SHORTEST, LONGEST + 1) for k in range(len(text) - size + 1))
                if len(counts) >= HELD:
                    yield send()
                    counts.clear()
        if counts:
            yield send()

    grams = written(words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    begin = grams.filter(F.col("n") > list_words).select(F.col("gram").alias("begin"), F.col("n").alias("of"))
    longer = grams.filter(F.char_length("gram") > SHORTEST).withColumn("begin", F.expr("left(gram, char_length(gram) - 1)")).join(begin, "begin")
    # how many grams would go with each doubling of the limit
    step = F.floor(F.log2((F.col("of") - 1) / F.lit(float(list_words)))).cast("int")
    sizes = {r["step"]: r["n"] for r in longer.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    limit, left = list_words, sum(sizes.values())
    for k in range(max(sizes, default=-1) + 1):
        if left <= most_grams:
            break
        left -= sizes.get(k, 0)
        limit = list_words << k + 1
    kept = longer.filter(F.col("of") > limit).select("gram", "n").collect()
    two = grams.filter(F.char_length("gram") == SHORTEST).collect()
    discard(grams)
    return GramDictionary({r["gram"] for r in kept}, {r["gram"]: r["n"] for r in (*kept, *two)})


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` (words of one length, or one longer) differ from those of ``a`` by exactly one edit."""
    n = a.shape[1]
    differs = a != b[:, :n]
    if b.shape[1] == n:
        return differs.sum(1) == 1
    left = np.where(differs.any(1), differs.argmax(1), n)
    later = (a != b[:, 1:])[:, ::-1]
    right = np.where(later.any(1), later.argmax(1), n)
    return left + right >= n


def near_in_lists(key: np.ndarray, size: np.ndarray, kind: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs of near words that share a list."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    lengths = np.array([len(w) for w in words], np.int64)
    for s, k in sorted(set(zip(size.tolist(), kind.tolist(), strict=True))):
        rows = np.flatnonzero((size == s) & (kind == k))
        rows = rows[np.lexsort((lengths[rows], key[rows]))]
        n = s - 2
        chars = np.zeros((len(rows), n + k), np.uint32)
        for length in {n, n + k}:
            own = np.flatnonzero(lengths[rows] == length)
            chars[own, :length] = np.frombuffer("".join(words[r] for r in rows[own].tolist()).encode("utf-32-le"), np.uint32).reshape(len(own), length)
        here, its_key, is_long = np.arange(len(rows)), key[rows], lengths[rows] > n
        at_once = max(1, COMPARED // max(1, n))
        for step in range(1, len(rows)):
            here = here[here + step < len(rows)]
            here = here[its_key[here] == its_key[here + step]]
            if not len(here):
                break
            pairs = here[is_long[here + step] & ~is_long[here]] if k == LONGER else here
            for part in np.split(pairs, range(at_once, len(pairs), at_once)):
                found = part[one_edit(chars[part, :n], chars[part + step])]
                out.append((rows[found], rows[found + step]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_words(words: DataFrame, list_words: int = 4096, most_grams: int = 1 << 17, most_rows: int = 256, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All pairs of distinct words that differ by exactly one character that comes, goes or is replaced, in both directions:
    ``word``, ``n``, ``near``, ``near_n``. ``words`` has distinct ``word`` and ``n`` and is read several times.

    Lists whose counter shows more than ``most_rows`` rows are split further by halving the part in which the edit may be,
    until it is a single place; then a list has at most one word for each letter. No list is cut.
    """
    grams = gram_dictionary(words, list_words, most_grams)
    pairs = GramDictionary(set(), grams.counts)
    shared = words.sparkSession.sparkContext.broadcast((grams, pairs))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["size", "kind", "a", "b"]
        dictionary, twos = shared.value
        for batch in sliced(batches, 2000):
            lists = [sorted(lists_of(w, dictionary, twos)) for w in batch["word"].to_pylist()]
            of = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            columns = np.array([x for own in lists for x in own], np.int32).reshape(-1, 4)
            for at in range(0, len(of), SENT):
                rows, numbers = of.slice(at, SENT), columns[at : at + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in numbers.T] + [batch["word"].take(rows), batch["n"].take(rows)], [*names, "word", "n"])

    def keyed(rows: DataFrame) -> DataFrame:
        text = F.concat(F.lit(BEGIN), "word", F.lit(END))
        return rows.withColumn("key", F.xxhash64("size", "kind", "a", "b", F.left(text, F.col("a")), F.right(text, F.col("b"))))

    slot = F.pmod(F.col("key"), F.lit(SLOTS)).cast("int")
    rest = F.col("size") - F.col("a") - F.col("b")
    splits = F.when(F.col("kind") == SAME, rest > 1).otherwise(rest > 0)
    spread = words.select("word", "n").repartition(max(1, -(-words.count() // WORDS)), "word")
    rows = written(keyed(spread.mapInArrow(look_up, "size int, kind int, a int, b int, word string, n long")), "lists")
    kept: list[DataFrame] = []
    while True:
        most = max(most_rows, 4 * rows.count() // SLOTS)
        counted = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("rows"), F.max(splits).alias("splits"))
        # at most a quarter of the slots have over four times the mean
        crowded = written(counted.filter((F.col("rows") > most) & F.col("splits")).select("slot"), "crowded")
        if crowded.isEmpty():
            break
        marked = rows.withColumn("slot", slot).join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "slot", "left").drop("slot")
        goes = F.coalesce("crowded", F.lit(False)) & splits
        kept.append(marked.filter(~goes).drop("crowded"))
        # the edit is behind the first half, or before the second; one that adds a character may also be at either end
        half = F.floor((rest + F.col("kind")) / 2).cast("int")
        finer = F.array(F.struct((F.col("a") + half).alias("a"), "b"), F.struct("a", (F.col("b") + rest - half + F.col("kind")).alias("b")))
        split = marked.filter(goes).withColumn("to", F.explode(finer)).select("size", "kind", F.col("to.a").alias("a"), F.col("to.b").alias("b"), "word", "n").distinct()
        rows = written(keyed(split), "lists")
    for part in kept:
        rows = rows.unionByName(part)
    held = rows.agg(F.coalesce(F.sum(4 * F.char_length("word") + 32), F.lit(0))).first()[0]
    buckets = int(max(1, -(-held // bucket_bytes)))

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, two = near_in_lists(*(table[c].to_numpy() for c in ("key", "size", "kind")), table["word"].to_pylist())
        left, right = pa.array(np.concatenate([one, two])), pa.array(np.concatenate([two, one]))
        found = pa.table({"word": table["word"].take(left), "n": table["n"].take(left), "near": table["word"].take(right), "near_n": table["n"].take(right)})
        return found.group_by(found.column_names).aggregate([])

    found = rows.select("key", "size", "kind", "word", "n").groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(merge, "word string, n long, near string, near_n long")
    return found.repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for rows ``word``, ``form`` without cycles: the last word that is reached from form to form. Each round doubles the
    steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").isEmpty()
        discard(at)
        at = after.select("word", "root")
        if moved:
            return at


def group_spellings(words: DataFrame, times: int = 2, **options: int) -> DataFrame:
    """Each word with the spelling it stands for: its near word with the most occurrences (ties: the first in code-point
    order), if that has at least ``times`` as many as the word itself.

    ``words`` has ``word`` and ``n`` with n of at least 1, as count_words() gives them. Returns ``word``, ``form`` (null without such a near word),
    ``root`` (the last form that is reached from form to form; the word itself without a form), ``n``, ``n_near`` and ``form_n``.

    Defined cases: words that repeat are one, with the sum of their ``n``; a null word takes no part; words of any length
    are compared whole; an empty table gives an empty table; further columns are left out.
    """
    if times < 2:
        raise ValueError("a form must have at least twice the occurrences, or forms could go round in circles")
    plain = written(words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    per_word = near_words(plain, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    near = written(per_word.select("word", "n_near", F.when(-F.col("best.order") >= times * F.col("own"), F.struct(F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n"))).alias("to")), "near")
    last = roots(near.filter("to is not null").select("word", F.col("to.form").alias("form")))
    joined = plain.join(near, "word", "left").join(last, "word", "left")
    return joined.select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("to.form_n").alias("form_n"))
