"""Dictionary: a code for each element, and the value of each code. Values may have any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...sources.store import numbered
from ...types import EncodingError, Word
from .common import in_range, window_of


FEW = 1 << 16  # entries that are numbered in one task; more are numbered by ranges


def build(values: DataFrame, limit: int) -> DataFrame:
    """(code, value) of the distinct values in order. More than limit of them, what a code can hold, is an error."""
    distinct = values.select("value").distinct()
    n = distinct.count()
    if n > limit:
        raise EncodingError(f"dictionary: more than {limit} values")
    if n > FEW:
        return numbered(distinct, "value").select(F.col("pos").alias("code"), "value")
    return distinct.select((F.row_number().over(Window.orderBy("value")) - 1).cast("bigint").alias("code"), "value")


def encode(df: DataFrame, length: int, stored: Word, of: Word | None = None) -> EncodedColumn:
    """of: the values' word, where they are machine words."""
    entries = build(df, 1 << stored.bits)
    codes = df.join(entries, df["value"].eqNullSafe(entries["value"])).select("pos", F.col("code").cast(stored.spark()).alias("code"))
    return EncodedColumn("dictionary", length, {"stored": stored.name} | ({"word": of.name} if of else {}), {"compressed_input": codes, "dictionary_entries": entries})


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None, strict: bool = True) -> DataFrame:
    """strict: a code without an entry is an error, else its element is missing. The join is broadcast where Spark finds
    the entries small."""
    lo, hi = window_of(column, lo, hi)
    codes = in_range(column.part("compressed_input", "pos", "code"), lo, hi, column.length)
    entries = column.part("dictionary_entries", "code", "value").select(F.col("code").cast("bigint").alias("code"), "value", F.lit(True).alias("_in"))
    found = codes.select("pos", F.col("code").cast("bigint").alias("code")).join(entries, "code", "left" if strict else "inner")
    if not strict:
        return found.select("pos", "value")
    missing = F.raise_error(F.concat(F.lit("dictionary: no entry for code "), F.col("code").cast("string")))
    return found.select("pos", F.when(F.col("_in").isNull(), missing).otherwise(F.col("value")).alias("value"))
