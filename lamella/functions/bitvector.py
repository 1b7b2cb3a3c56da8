"""Packed bit vectors: (word BIGINT, bits BIGINT) rows, 32 positions to a word, lowest bit first; absent words are zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits as B

WIDTH = 32


def pack(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Bit pos is set where predicate(value) holds; a null result counts as false. Every word with a position has a row."""
    bit = F.when(predicate(F.col("value")), B.shift_left(F.lit(1), F.expr(f"pos % {WIDTH}"))).otherwise(F.lit(0).cast("bigint"))
    return df.groupBy(F.expr(f"pos div {WIDTH}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpack(vector: DataFrame, length: int) -> DataFrame:
    """(pos, value BOOLEAN) of the vector's words, without the slack bits beyond length."""
    rows = vector.select((F.col("word") * WIDTH).alias("_at"), "bits", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("k"))
    return rows.select((F.col("_at") + F.col("k")).alias("pos"), (B.bit_subsequence(F.col("bits"), F.col("k"), 1) == 1).alias("value")).where(F.col("pos") < length)


def get(vector: DataFrame, positions: DataFrame) -> DataFrame:
    """(pos, value) for positions (pos)."""
    rows = positions.select("pos", F.expr(f"pos div {WIDTH}").alias("word")).join(vector, "word", "left")
    return rows.select("pos", (B.bit_subsequence(F.coalesce("bits", F.lit(0)), F.expr(f"pos % {WIDTH}"), 1) == 1).alias("value"))


def _masks(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.expr(f"pos div {WIDTH}").alias("word")).agg(F.bit_or(B.shift_left(F.lit(1), F.expr(f"pos % {WIDTH}"))).alias("mask"))


def _changed(vector: DataFrame, positions: DataFrame, f) -> DataFrame:
    """f(bits, mask) of every word; positions may name a bit several times."""
    both = vector.join(_masks(positions), "word", "full")
    return both.select("word", f(F.coalesce("bits", F.lit(0).cast("bigint")), F.coalesce("mask", F.lit(0).cast("bigint"))).alias("bits"))


def set_bits(vector: DataFrame, positions: DataFrame) -> DataFrame:
    return _changed(vector, positions, lambda b, m: b.bitwiseOR(m))


def unset_bits(vector: DataFrame, positions: DataFrame) -> DataFrame:
    return _changed(vector, positions, lambda b, m: b.bitwiseAND(F.bitwise_not(m)))


def flip_bits(vector: DataFrame, positions: DataFrame) -> DataFrame:
    return _changed(vector, positions, lambda b, m: b.bitwiseXOR(m))


def set_to(vector: DataFrame, positions: DataFrame, value: bool) -> DataFrame:
    return set_bits(vector, positions) if value else unset_bits(vector, positions)


def set_all(spark, length: int) -> DataFrame:
    return clear_slack(spark.range(-(-length // WIDTH)).select(F.col("id").alias("word"), F.lit(B.one_bits(WIDTH)).alias("bits")), length)


def unset_all(spark, length: int) -> DataFrame:
    return spark.range(-(-length // WIDTH)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))


def clear_slack(vector: DataFrame, length: int) -> DataFrame:
    """Bits at length and beyond become zero; a length that fills its last word has no slack."""
    last, used = divmod(length, WIDTH)
    keep = F.when(F.col("word") < last, F.col("bits")).when(F.col("word") == last, F.col("bits").bitwiseAND(F.lit(B.one_bits(used)))).otherwise(F.lit(0).cast("bigint"))
    return vector.select("word", keep.alias("bits"))


def take(vector: DataFrame, first_word: int, words: int) -> DataFrame:
    """A slice by whole words, numbered from 0."""
    return vector.where(F.col("word").between(first_word, first_word + words - 1)).select((F.col("word") - first_word).alias("word"), "bits")


def rank(vector: DataFrame, positions: DataFrame) -> DataFrame:
    """(pos, rank): set bits before each position; absent words are zero."""
    from ..operators.scan import exclusive_prefix

    words = vector.select("word", "bits").unionByName(positions.select(F.expr(f"pos div {WIDTH}").cast("bigint").alias("word"), F.lit(0).cast("bigint").alias("bits")))
    counts = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("n", F.bit_count("bits").cast("bigint")).withColumn("seg", F.expr("word div 1024"))
    upper = exclusive_prefix(counts.groupBy("seg").agg(F.sum("n").alias("total")))
    own = F.sum("n").over(Window.partitionBy("seg").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("own", own).join(upper, "seg").select("word", "bits", (F.coalesce("own", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("before"))
    rows = positions.select("pos", F.expr(f"pos div {WIDTH}").alias("word")).join(before, "word")
    low = B.shift_left(F.lit(1), F.expr(f"pos % {WIDTH}")) - 1
    return rows.select("pos", (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(low))).cast("bigint").alias("rank"))


def first_and_last_set(vector: DataFrame) -> DataFrame:
    """One row (first_set, last_set): 1-based places in the whole vector, 0 where no bit is set."""
    at = F.col("word") * WIDTH
    used = F.col("bits") != 0
    return vector.agg(
        F.coalesce(F.min(F.when(used, at + B.find_first_set(F.col("bits"), WIDTH))), F.lit(0)).cast("bigint").alias("first_set"),
        F.coalesce(F.max(F.when(used, at + B.find_last_set(F.col("bits"), WIDTH))), F.lit(0)).cast("bigint").alias("last_set"),
    )
