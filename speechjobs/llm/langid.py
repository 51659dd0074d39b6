"""Language identification of whole and mixed texts: script ranges, word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from speechjobs.llm.hashing import sliced

#: First code points of script ranges; a range ends where the next one begins.
SCRIPTS = {
    0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic", 0x0780: "Other", 0x0900: "Devanagari",
    0x0980: "Bengali", 0x0A00: "Indic", 0x0E00: "Thai", 0x0E80: "Other", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1200: "Other", 0x1E00: "Latin", 0x1F00: "Greek",
    0x2000: "Other", 0x3040: "Kana", 0x3100: "Other", 0x3400: "Han", 0xA000: "Other", 0xAC00: "Hangul", 0xD7B0: "Other", 0xF900: "Han", 0xFB00: "Other",
}
SCRIPT_NAMES = sorted(set(SCRIPTS.values()))
#: Letter trigrams fall into this many counters for each language.
FEATURES = 1 << 16
#: Nats that a change of language between two words costs.
SWITCH_PENALTY = 8.0
#: A language uses a script if at least this share of its letters is in it.
LEAST_SHARE = 1e-3
#: Characters that a task works on at once; a longer text is one piece of work.
WORK_CHARS = 1_000_000
UNKNOWN = "und"
#: Languages that a model may have: it is FEATURES numbers for each, on the driver and in every task.
MOST_LANGUAGES = 256
#: Languages whose counters a task of the training holds before it sends them.
HELD_LANGUAGES = 32
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point below 2^16, and at 2^16 for all above: is a letter, belongs to a word, lower case, script."""
    chars = [chr(i) for i in range(1 << 16)] + [chr(0x10400)]
    letter = np.array([c.isalpha() for c in chars])
    word = letter | np.array([unicodedata.category(c)[0] == "M" for c in chars])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    starts = sorted(SCRIPTS)
    script = np.array([SCRIPT_NAMES.index(SCRIPTS[s]) for s in starts], np.uint8)[np.searchsorted(starts, np.arange(len(chars)), "right") - 1]
    script[-1] = SCRIPT_NAMES.index("Other")
    return letter, word, lower, script


class Words:
    """The words of several texts, as numbers.

    ``starts``/``ends``: code point range of each word within its text; ``doc``: its text; ``script``: of its first
    letter; ``feature``/``of``: trigram counters of all letters and the words they belong to; ``letters``: per text.
    """

    def __init__(self, texts: list[str]):
        letter, word, lower, script = _tables()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(points, 1 << 16)
        inside = word[small]
        shape = np.where(inside, np.where(points < 1 << 16, lower[small], points), 0).astype(np.uint64)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.doc = np.searchsorted(bounds, begin, "right") - 1
        self.starts, self.ends = begin - bounds[self.doc], end - bounds[self.doc]
        self.script = script[small[begin]]
        at = np.flatnonzero(inside)
        before, after = shape[np.maximum(at - 1, 0)], shape[np.minimum(at + 1, len(shape) - 1)]
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (shape[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
        self.feature = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64) % FEATURES
        self.sizes = end - begin
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        real = np.add.reduceat(letter[small], bounds[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        self.has_letter = real > 0


def _pieces_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Row numbers in groups of about WORK_CHARS characters, long texts together."""
    sizes = np.array([len(t or "") for t in texts])
    order = np.argsort(-sizes, kind="stable")
    group = np.cumsum(sizes[order]) // WORK_CHARS
    yield from np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probability of each trigram counter and language, and which scripts each language uses.

    Counts cover all rows with a text and a language. Tasks add up in arrays, Spark sums these by language and counter;
    the model that comes to the driver is FEATURES numbers for each language, whatever the number of documents.

    Defined cases: rows without a text or a language are not learned from; repeated rows count; an empty table, or one
    without labels, gives a model without languages; a column of more than ``most_languages`` values is refused before
    anything is collected, for it holds something else than languages, and none of its values can be left out;
    further columns are ignored, whatever their names.
    """

    def send(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "at": at.astype(np.int32), "n": counts[at]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 2000):
            langs = np.array(batch["lang"].to_pylist(), object)
            texts = batch["text"].to_pylist()
            for rows in _pieces_of(texts):
                words = Words([texts[i] for i in rows])
                names, which = np.unique(langs[rows].astype(str), return_inverse=True)
                own = which[words.doc]
                for k, name in enumerate(names):
                    mine = own == k
                    seen = np.bincount(words.feature[np.repeat(mine, words.sizes)], minlength=FEATURES)
                    script = np.bincount(words.script[mine], words.sizes[mine], len(SCRIPT_NAMES)).astype(np.int64)
                    total[name] = total.get(name, 0) + np.concatenate([seen, script])
                if len(total) > HELD_LANGUAGES:
                    yield from send(total)
                    total = {}
        yield from send(total)

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.select("lang").distinct().count()
    if known > most_languages:
        raise ValueError(f"{lang_col} has {known} values; a model of languages may have {most_languages}")
    table = rows.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((FEATURES + len(SCRIPT_NAMES), len(names)))
    counts[table["at"], [names.index(x) for x in table["lang"]]] = table["n"]
    trigrams, scripts = counts[:FEATURES], counts[FEATURES:]
    model = np.log((trigrams + 0.5) / (trigrams.sum(0) + 0.5 * FEATURES))
    return names, model.astype(np.float32), scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1)


def viterbi(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; all texts go forward together, word by word.

    ``score``: words x labels; ``doc``: text of each word, rising. A change of label costs ``penalty``; ties keep the
    label, then take the first.
    """
    n_words, labels = score.shape
    out = np.zeros(n_words, np.int64)
    if not n_words:
        return out
    begin = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    sizes = np.diff(begin, append=n_words)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    back = np.zeros((n_words, labels), np.int16)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    value = score[begin].astype(np.float64)
    here = np.arange(labels)
    last = np.zeros(len(begin), np.int64)
    for t in range(1, sizes[0]):
        k = alive[t]
        if k < len(value):
            last[k : len(value)] = value[k:].argmax(1)
            value = value[:k]
        top = value.argmax(1)
        other = value[np.arange(k), top] - penalty
        stay = value >= other[:, None]
        at = begin[:k] + t
        back[at] = np.where(stay, here, top[:, None])
        value = np.where(stay, value, other[:, None]) + score[at]
    last[: len(value)] = value.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        at = begin[: alive[t]] + t
        out[at] = last[: alive[t]]
        last[: alive[t]] = back[at, last[: alive[t]]]
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Label spans of every whole text with languages, and each text with the language of most of its letters.

    A word competes only among the languages that use the script of its first letter (all, if none does). Its score for
    a language is the sum of log probabilities of its letter trigrams. The best labelling of a text's words, where each
    change of language costs ``penalty``, is found by Viterbi.

    Returns the id, the columns named in ``keep``, ``lang_pred``, ``score`` (its share of the letters, 0 to 1) and
    ``spans`` (array of start, end, lang: code point ranges of the text).

    Defined cases: null and empty texts and texts without a letter are ``und`` with score 0 and no spans, and so is every
    text when no language was learned; equal shares go to the first language by name; repeated rows are labelled each;
    an empty table gives an empty table; columns of ``docs`` that are called like the new ones give way to them, and columns
    not named in ``keep`` are left out.
    """
    names, table, uses = model
    # at most MOST_LANGUAGES x FEATURES numbers, see train()
    shared = docs.sparkSession.sparkContext.broadcast((names, table, uses))
    kept = [f.name for f in docs.schema if f.name in (id_col, *keep) and f.name not in ("lang_pred", "score", "spans")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, uses = shared.value
        allowed = np.where(uses.any(1)[:, None], uses, True) if names else uses
        for batch in sliced(batches, 2000):
            texts = batch["__text"].to_pylist()
            pred, share, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
            for rows in _pieces_of(texts) if names else ():
                words = Words([texts[i] or "" for i in rows])
                if not len(words.doc):
                    continue
                each = np.add.reduceat(table[words.feature], words.first, axis=0) + np.where(allowed[words.script], 0, -1e6)
                lang = viterbi(each, words.doc, penalty)
                letters = np.bincount(words.doc * len(names) + lang, words.sizes, len(rows) * len(names)).reshape(len(rows), -1)
                change = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(words.doc, prepend=-1) != 0))
                ends = np.append(change[1:] - 1, len(lang) - 1)
                ranges: dict[int, list] = {}
                for d, a, b, x in zip(words.doc[change].tolist(), words.starts[change].tolist(), words.ends[ends].tolist(), lang[change].tolist(), strict=True):
                    ranges.setdefault(d, []).append({"start": a, "end": b, "lang": names[x]})
                for d in np.flatnonzero(words.has_letter & (letters.sum(1) > 0)).tolist():
                    best = int(letters[d].argmax())
                    pred[rows[d]], share[rows[d]], spans[rows[d]] = names[best], letters[d, best] / letters[d].sum(), ranges[d]
            columns = {c: batch[c] for c in batch.schema.names if c != "__text"}
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(share), "spans": pa.array(spans, kind)})

    schema = StructType([*docs.select(*(F.col(f"`{c}`") for c in kept)).schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("__text")).mapInArrow(label, schema)
