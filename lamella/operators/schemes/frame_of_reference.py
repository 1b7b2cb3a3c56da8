"""Frame of reference: each segment's model of the position in it, plus an offset for each element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...functions.models import evaluate
from ...types import EncodingError, Word, wide, wrap
from .common import check_word, in_range, in_segments, of_segment, positions, window_of


def check_segments(n: int) -> int:
    if n % 4:
        raise EncodingError("frame of reference: segment_length must be a multiple of 4")
    return n


def encode(df: DataFrame, length: int, segment_length: int, of: Word, stored: Word, model: str = "constant") -> EncodedColumn:
    """constant: the segment's least value. linear: the slope between its ends, and the intercept that leaves no offset
    below zero. Offsets that stored can't hold are errors."""
    check_segments(segment_length)
    rows = df.select("pos", wide(F.col("value"), of).alias("v")).withColumn("seg", of_segment(df, segment_length))
    x = F.expr(f"pos % {segment_length}")
    if model == "constant":
        coefficients = rows.groupBy("seg").agg(F.min("v").cast("bigint").alias("c0"))
        guess = F.col("c0")
    elif model == "linear":
        ends = rows.groupBy("seg").agg(F.min_by("v", "pos").alias("a"), F.max_by("v", "pos").alias("b"), F.count(F.lit(1)).alias("n"))
        slopes = ends.select("seg", F.expr("cast((b - a) div greatest(n - 1, 1) as bigint)").alias("c1"))
        coefficients = rows.join(slopes, "seg").groupBy("seg").agg(F.min(F.col("v") - F.col("c1") * x).cast("bigint").alias("c0"), F.first("c1").alias("c1"))
        guess = F.col("c0") + F.col("c1") * x
    else:
        raise EncodingError(f"frame of reference: can't fit model {model!r}")
    offset = F.col("v") - guess
    offset = F.when((offset >= stored.low) & (offset <= stored.high), offset).otherwise(F.raise_error(F.lit(f"frame of reference: an offset beyond {stored.name}")).cast("bigint"))
    offsets = rows.join(coefficients, "seg").select("pos", offset.cast(stored.spark()).alias("offset"))
    params = {"segment_length": segment_length, "word": of.name, "stored": stored.name, "model": model}
    return EncodedColumn("frame_of_reference", length, params, {"compressed_input": offsets, "segment_model_coefficients": coefficients})


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    of, n = check_word(column), check_segments(column.segment_length())
    lo, hi = window_of(column, lo, hi)
    offsets = positions(column.part("compressed_input", "pos", "offset"), lo, hi, n, column.length)
    coefficients = in_segments(column.part("segment_model_coefficients", "seg"), lo, hi, n, column.length)
    names = sorted((c for c in coefficients.columns if c[0] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    rows = offsets.withColumn("seg", of_segment(offsets, n)).join(coefficients.select("seg", *names), "seg")
    value = evaluate(column.param("model", "constant"), [F.col(c) if dict(coefficients.dtypes)[c] in ("double", "float") else F.col(c).cast("bigint") for c in names], F.expr(f"pos % {n}"))
    return in_range(rows.select("pos", wrap(wide(value, of) + wide(F.col("offset"), of), of).alias("value")), lo, hi, column.length)
