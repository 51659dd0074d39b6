"""Pronunciation lexicon: building it, and turning texts into phonemes with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechjobs import constants as K
from speechjobs.functions.symbols import australian, from_ipa
from speechjobs.sources.shared import written

#: Copies of a large lexicon, for frequent words.
SALTS = 16


def normalised_words(text: Column) -> Column:
    """Lower-case dictionary words of a text; digits and punctuation separate words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z' ]+", " "), " +"), lambda w: w != "")


def dictionary_lines(files: DataFrame) -> DataFrame:
    """(line, word, ipa) of dictionary files read whole (column value): "WORD(2), i p a" lines, in file order."""
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "entry")).filter("entry <> ''")
    parts = lines.select("line", F.split("entry", ", ", 2).alias("p"))
    return parts.select("line", F.lower(F.substring_index(F.col("p")[0], "(", 1)).alias("word"), F.col("p")[1].alias("ipa"))


def first_variants(lines: DataFrame, word: str = "word", order: str = "line") -> DataFrame:
    """The first listed pronunciation of each word; heads that do not start with a letter are left out."""
    first = Window.partitionBy(word).orderBy(order)
    return lines.filter(F.col(word).rlike(r"^\p{L}")).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def build_lexicon(american: DataFrame, british: DataFrame) -> DataFrame:
    """(word, ga, rp, au) for words in both dictionaries; au only where it differs from rp.

    ``american``: (word, variant, phonemes); ``british``: (line, word, ipa).
    """
    ga = american.filter("variant = 0").select("word", F.col("phonemes").alias("ga"))
    rp = first_variants(british).select("word", from_ipa(F.col("ipa")).alias("rp"))
    both = ga.join(rp, "word").withColumn("au", australian(F.col("rp"), F.col("ga"), F.col("word")))
    return both.select("word", "ga", "rp", F.when(F.col("au") != F.col("rp"), F.col("au")).alias("au"))


def lexicon_statistics(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count("*").alias("words"), F.count_if(F.col("ga") != F.col("rp")).alias("differing"), F.count("au").alias("australian"))


def entry(accent: Column) -> Column:
    """A lexicon row's phonemes in an accent: au falls back to rp, all others to ga. An unknown accent fails."""
    known = F.when(accent == "au", F.coalesce("au", "rp")).when(accent == "rp", F.coalesce("rp", "ga")).when(accent == "ga", F.col("ga"))
    return known.otherwise(F.array(F.raise_error(F.concat(F.lit("unknown accent "), F.coalesce(accent, F.lit("null")))).cast("string")))


class PhonemeTable:
    """The phonemes of words in each accent, as one Arrow list with a block of entries for each accent."""

    def __init__(self, rows: pa.Table):
        self.words = rows["word"].combine_chunks()
        blocks = [rows[a].combine_chunks() for a in K.ACCENTS]
        self.lists = pa.concat_arrays(blocks)
        self.sizes = pc.fill_null(pc.list_value_length(self.lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.without = self.lists.is_null().to_numpy(zero_copy_only=False)

    def look_up(self, words: pa.ListArray, accents: list[str]) -> tuple[pa.ListArray, pa.Array]:
        """Phonemes of each text's words, one after the other, and the first word of each text that is not there."""
        if unknown := set(accents) - set(K.ACCENTS):
            raise ValueError(f"unknown accent {min(unknown, key=str)}")
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])
        flat = words.flatten()
        at = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(words)), np.diff(bounds))
        missing = np.flatnonzero(at < 0)
        first = np.full(len(words), -1)
        first[text[missing][::-1]] = missing[::-1]
        block = np.array([K.ACCENTS.index(a) for a in accents], np.int64) * len(self.words)
        entry = at + block[text]
        lost = first >= 0
        lost[text[(at >= 0) & self.without[np.maximum(entry, 0)]]] = True
        use = ~lost[text]
        size = np.zeros(len(text), np.int64)
        size[use] = self.sizes[entry[use]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, size, len(words)))]).astype(np.int32)
        values = self.lists.take(pa.array(entry[use])).flatten()
        phonemes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(lost)) if len(words) else pa.array([], pa.list_(pa.string()))
        return phonemes, flat.take(pa.array(first, mask=first < 0))


def text_phonemes(texts: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "id", accent: str = "accent", most_words: int = 200_000) -> DataFrame:
    """(id, phonemes, unknown_word) for each row of (id, text, accent). A text with a word that is not in the lexicon has
    null phonemes, and the first such word is named. Ids must be unique.

    A lexicon of up to ``most_words`` words goes to all tasks, which look the words of a text up where they are: no word is
    shuffled. A larger one is joined by word, with a salt, for a few words make up most of any text.
    """
    held = written(lexicon.select("word", "ga", "rp", "au"), "lexicon")
    words = normalised_words(F.col(text))
    if held.count() <= most_words:
        shared = texts.sparkSession.sparkContext.broadcast(PhonemeTable(held.select("word", *[entry(F.lit(a)).alias(a) for a in K.ACCENTS]).toArrow()))
        id_type = texts.schema[id_col].dataType

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                phonemes, unknown = shared.value.look_up(batch["words"], batch["accent"].to_pylist())
                yield pa.RecordBatch.from_arrays([batch["id"], phonemes, unknown], [id_col, "phonemes", "unknown_word"])

        schema = T.StructType([T.StructField(id_col, id_type), T.StructField("phonemes", T.ArrayType(T.StringType())), T.StructField("unknown_word", T.StringType())])
        return texts.select(F.col(id_col).alias("id"), F.col(accent).alias("accent"), words.alias("words")).mapInArrow(spell, schema)
    each = texts.select(F.col(id_col).alias("id"), F.col(accent).alias("accent"), F.posexplode_outer(words).alias("pos", "word")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = held.withColumns({"known": F.lit(True), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    found = each.join(salted, ["word", "salt"], "left")
    missing = F.col("word").isNotNull() & F.col("known").isNull()
    parts = F.when(F.col("known"), F.struct("pos", entry(F.col("accent")).alias("p")))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(parts)), lambda s: s["p"]))
    out = found.groupBy("id").agg(joined.alias("phonemes"), F.min(F.when(missing, F.struct("pos", "word"))).alias("miss"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("miss").isNull(), F.col("phonemes")).alias("phonemes"), F.col("miss.word").alias("unknown_word"))


def text_problem(text: Column) -> Column:
    """Why a text cannot be practised, or null: it must have 1 to 8 words and at most 60 characters."""
    n = F.size(normalised_words(text))
    return F.when(F.coalesce(n, F.lit(0)) < 1, "empty").when(n > 8, "too many words").when(F.char_length(text) > 60, "too long")


def practice_words(bank: DataFrame, lexicon: DataFrame, accent: str, recordings: DataFrame | None = None, difficulty: str | None = None) -> DataFrame:
    """Words of the bank with the accent's target, whether it differs from American, and whether a recording exists."""
    chosen = bank if difficulty is None else bank.filter(F.col("difficulty") == difficulty)
    out = chosen.join(lexicon, "word").withColumn("target", entry(F.lit(accent))).withColumn("distinct", F.col("target") != F.col("ga"))
    if recordings is None:
        return out.select("difficulty", "word", "seq", "target", "distinct", F.lit(False).alias("recorded"))
    have = recordings.filter(F.col("accent") == accent).select("word", F.lit(True).alias("have")).distinct()
    return out.join(have, "word", "left").select("difficulty", "word", "seq", "target", "distinct", F.coalesce("have", F.lit(False)).alias("recorded"))


def target_range(texts: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """Fewest and most sounds that a sentence has over all accents."""
    every = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).crossJoin(texts.sparkSession.createDataFrame([(a,) for a in K.ACCENTS], "accent string"))
    every = every.withColumn("key", F.struct("id", "accent"))
    sizes = text_phonemes(every, lexicon, id_col="key").select("key.id", F.size("phonemes").alias("n"))
    return sizes.groupBy("id").agg(F.min("n").alias("fewest"), F.max("n").alias("most")).withColumnRenamed("id", id_col)


def vocabulary(sequences: DataFrame, column: str, special: tuple[str, ...] = ("[UNK]", "[PAD]")) -> DataFrame:
    """(symbol, id): distinct symbols in order from 0, then the special ones. Symbols are a small, closed set."""
    symbols = sequences.select(F.explode(column).alias("symbol")).filter("symbol is not null").distinct()
    spark = sequences.sparkSession
    both = symbols.select("symbol", F.lit(0).alias("late")).union(spark.createDataFrame([(s, i + 1) for i, s in enumerate(special)], "symbol string, late int"))
    return both.select("symbol", (F.row_number().over(Window.orderBy("late", "symbol")) - 1).alias("id"))


def encode(sequences: DataFrame, column: str, vocab: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """``ids``: upper-cased symbols as numbers, unknown ones as the number of ``unknown``. The vocabulary becomes one map."""
    codes = vocab.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "id"))).alias("__codes"))
    look = lambda s: F.coalesce(F.col("__codes")[F.upper(s)], F.col("__codes")[unknown])
    return sequences.crossJoin(codes).withColumn("ids", F.transform(column, look)).drop("__codes")
