"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechjobs.sources.shared import discard, written

__all__ = ["WORD", "discard", "row_key", "word_count", "written"]

#: Words are runs of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame, id_col: str, text_col: str, *salt: Column) -> Column:
    """A stable 64-bit hash of a row's id; rows without an id are told apart by their text."""
    text = F.xxhash64(F.col(text_col)) if text_col in df.columns else F.lit(0).cast("long")
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), text.cast("string"))), *salt)
