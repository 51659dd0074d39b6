"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechjobs.llm.common import written
from speechjobs.llm.langid import UNKNOWN, identify, train
from speechjobs.llm.mixing import Mix, apply_mix, merit_of_length
from speechjobs.llm.near_dedup import near_duplicates
from speechjobs.llm.packing import pack_documents
from speechjobs.llm.suffix_dedup import remove_repeats


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as ``row``, so that their names cannot clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0)])).alias("row"))


def _unpacked(df: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again, some of them changed, with their types."""
    new = {c: value.cast(docs.schema[c].dataType) for c, value in (changed or {}).items()}
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c) for c in docs.columns} | new
    return df.select(*[own[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, those of which no letter can be read in any learned one; texts in several
    languages stay. A missing ``lang`` is filled with the prediction.

    Defined cases: null and empty texts and texts without a letter go; with no labelled document at all nothing can be told
    apart, and all documents stay; repeated rows are judged each; rows without an id stay by their text; an empty table
    gives an empty table; other columns pass unchanged, whatever their names and types.
    """
    model = train(docs)
    if not model[0]:
        return docs
    known = identify(_packed(docs), model, keep=("text", "row")).filter(F.col("lang_pred") != UNKNOWN)
    return _unpacked(known, docs, {"lang": F.coalesce("row.lang", "lang_pred")})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one of the smallest id.

    Defined cases: rows that repeat an id are one document, of which one row stays (of several texts that of the
    smallest hash, of equal texts any); of a group in which no row has an id one row stays, chosen in the same way; null
    and empty texts and texts without words are no duplicates and all stay; an empty table gives an empty table; other
    columns pass unchanged, whatever their names and types.
    """
    groups = written(near_duplicates(docs.select("doc_id", "text")), "groups")
    copies = groups.filter("kept and group is not null").groupBy("group", "doc_id", "tie").agg(F.count("*").alias("n"))
    heads = copies.groupBy("group").agg(F.min(F.struct("tie", "doc_id", "n")).alias("h")).select(F.col("h.doc_id").alias("head_id"), F.col("h.tie").alias("head_tie"), F.col("h.n").alias("n"))
    # rows of an empty set are kept as they are
    plain = groups.filter("group is null").select(F.col("doc_id").alias("head_id"), F.col("tie").alias("head_tie"), F.lit(1).cast("long").alias("n")).distinct()
    keyed = _packed(docs).withColumn("tie", F.xxhash64("text"))
    chosen = keyed.join(heads.unionByName(plain), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    repeated = chosen.filter("n > 1").groupBy("doc_id", "tie").agg(F.first("text").alias("text"), F.first("row").alias("row"))
    columns = ["doc_id", "text", "row"]
    return _unpacked(chosen.filter("n = 1").select(columns).unionByName(repeated.select(columns)), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes and more that also start earlier; documents of which nothing is left go.

    Defined cases: null and short texts stay; rows that repeat id and text are one document, each cut alike; rows without
    an id come after all others; ``n_chars`` follows the text; an empty table gives an empty table; other columns pass
    unchanged, whatever their names and types.
    """
    cut = remove_repeats(_packed(docs)).filter("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    length = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length(text))
    return _unpacked(cut, docs, {"text": text, "n_chars": length})


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion 3 : 1 : 2, repeating, at 150 % of all words and at most two copies of a document; longer
    documents are likelier to be taken. Copies are equal rows.

    Defined cases: null texts have size 0; a missing source is a source; rows that repeat an id are taken each on its own, rows
    without one by their text; an empty table gives an empty table; other columns pass unchanged, whatever their names and types.
    """
    return apply_mix(docs, Mix(merit=merit_of_length()).fit(docs.select("doc_id", "text", "source")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their texts, in training sequences of the permitted lengths. ``row_id`` tells the copies
    of a document apart; the texts of a ``bin`` in the order of ``bin_start`` are its sequence.

    Defined cases: null texts and texts without words have no pieces; repeated rows and rows without an id are packed each
    on its own; an empty table gives an empty table; other columns are left out.
    """
    return pack_documents(docs, with_text=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("source_mix", source_mix), ("packing", packing)]
#: SQL cannot express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
