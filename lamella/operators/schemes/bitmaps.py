"""Incidence bitmaps: for each value a bitmap over the positions, in 32-bit containers, lowest bit first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...types import EncodingError, Word
from . import dictionary
from .common import check_word, in_range, window_of

MOST = 256


def encode(df: DataFrame, length: int, of: Word | None = None) -> EncodedColumn:
    """With a word, values are the bitmaps' numbers themselves; without, any values, and a dictionary of them."""
    params = {"bitmap_length": -(-length // 32)}
    parts = {}
    if of:
        codes = df.select("pos", F.col("value").cast("bigint").alias("code"))
        params |= {"word": of.name}
    else:
        entries = dictionary.build(df, MOST)
        codes = df.join(entries, "value").select("pos", "code")
        parts["dictionary_entries"] = entries
    bit = F.call_function("shiftleft", F.lit(1), F.expr("cast(pos % 32 as int)"))
    code = F.when(F.col("code").between(0, MOST - 1), F.col("code")).otherwise(F.raise_error(F.lit(f"bitmaps: more than {MOST} of them")).cast("bigint"))
    bits = codes.groupBy(code.cast("int").alias("bitmap"), F.expr("pos div 32").alias("container")).agg(F.bit_or(bit).alias("bits"))
    return EncodedColumn("bitmaps", length, params, {"incidence_bitmaps": bits} | parts)


def from_flat(flat: DataFrame, bitmap_length: int, alignment: int = 2) -> DataFrame:
    """(index, bits), where bitmap b begins at b times bitmap_length rounded up to the alignment, as (bitmap, container, bits)."""
    stride = -(-bitmap_length // alignment) * alignment
    return flat.select(F.expr(f"cast(index div {stride} as int)").alias("bitmap"), F.expr(f"index % {stride}").alias("container"), "bits").where(F.col("container") < bitmap_length)


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None, on_gap: str = "error") -> DataFrame:
    """Of several bitmaps that have a position, the highest number counts. on_gap, for positions that none has: "error",
    "null", or "skip"."""
    if on_gap not in ("error", "null", "skip"):
        raise EncodingError(f"bitmaps: on_gap can't be {on_gap!r}")
    lo, hi = window_of(column, lo, hi)
    bits = column.part("incidence_bitmaps", "bitmap", "container", "bits")
    if (lo, hi) != (0, column.length):
        bits = bits.where(F.col("container").between(lo // 32, max(lo, hi - 1) // 32))
    # First the set bits of a container in one row per bitmap, then the highest bitmap of each position.
    each = bits.select("bitmap", "container", F.explode(F.expr("filter(sequence(0, 31), k -> shiftrightunsigned(bits, k) & 1 = 1)")).alias("k"))
    found = each.groupBy((F.col("container") * 32 + F.col("k")).cast("bigint").alias("pos")).agg(F.max("bitmap").cast("bigint").alias("code")).where(F.col("pos") < column.length)
    found = in_range(found, lo, hi, column.length)
    if on_gap != "skip":
        every = bits.sparkSession.range(lo, hi).withColumnRenamed("id", "pos")
        found = every.join(found, "pos", "left")
        if on_gap == "error":
            gap = F.raise_error(F.concat(F.lit("bitmaps: none has position "), F.col("pos").cast("string"))).cast("bigint")
            found = found.withColumn("code", F.when(F.col("code").isNull(), gap).otherwise(F.col("code")))
    if "dictionary_entries" not in column.parts:
        return found.select("pos", F.col("code").cast(check_word(column).spark()).alias("value"))
    entries = column.part("dictionary_entries", "code", "value").select(F.col("code").cast("bigint").alias("code"), "value")
    return found.join(entries, "code", "left").select("pos", "value")
