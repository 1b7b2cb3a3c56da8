"""Delta: in each segment, an inclusive prefix sum of unsigned deltas on the segment's anchor, modulo the word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...types import EncodingError, Word, wide, wrap
from .common import check_word, in_range, in_segments, of_segment, positions, window_of


def encode(df: DataFrame, length: int, segment_length: int, of: Word, stored: Word) -> EncodedColumn:
    """df: (pos, value). A segment's anchor is its first value and its first delta 0, so segments are independent.
    Deltas are differences modulo the word; one that stored can't hold is an error."""
    if stored.size >= of.size:
        raise EncodingError("delta: deltas must be narrower than values")
    by = Window.partitionBy("seg").orderBy("pos")
    rows = df.select("pos", wide(F.col("value"), of).alias("v")).withColumn("seg", of_segment(df, segment_length))
    step = wrap(F.coalesce(F.col("v") - F.lag("v").over(by), F.lit(0)), Word(of.size))
    fits = F.when(step <= F.lit(str(stored.high)).cast("decimal(20,0)"), step).otherwise(F.raise_error(F.lit(f"delta: a difference beyond {stored.name}")))
    deltas = rows.select("pos", fits.cast(stored.spark()).alias("delta"))
    anchors = rows.groupBy("seg").agg(F.min_by("v", "pos").cast(of.spark()).alias("anchor"))
    return EncodedColumn("delta", length, {"segment_length": segment_length, "word": of.name, "stored": stored.name}, {"compressed_input": deltas, "anchor_values": anchors})


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    of, n = check_word(column), column.segment_length()
    lo, hi = window_of(column, lo, hi)
    deltas = positions(column.part("compressed_input", "pos", "delta"), lo, hi, n, column.length)
    anchors = in_segments(column.part("anchor_values", "seg", "anchor"), lo, hi, n, column.length)
    # One exchange by segment serves the join and the window.
    rows = deltas.withColumn("seg", of_segment(deltas, n)).join(anchors, "seg")
    total = F.sum(wide(F.col("delta"), of)).over(Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return in_range(rows.select("pos", wrap(wide(F.col("anchor"), of) + total, of).alias("value")), lo, hi, column.length)
