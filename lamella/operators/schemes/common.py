from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...types import EncodingError


def window_of(column: EncodedColumn, lo: int | None, hi: int | None) -> tuple[int, int]:
    lo, hi = 0 if lo is None else lo, column.length if hi is None else hi
    if lo < 0 or hi > column.length or lo > hi:
        raise EncodingError(f"{column.scheme}: positions {lo}..{hi} of a column of {column.length}")
    return lo, hi


def in_segments(df: DataFrame, lo: int, hi: int, length: int, whole: int, seg: str = "seg") -> DataFrame:
    """Rows of the segments that hold lo..hi; all of them without a filter when that is the whole column."""
    if (lo, hi) == (0, whole):
        return df
    return df.where(F.col(seg).between(lo // length, max(lo, hi - 1) // length))


def in_range(df: DataFrame, lo: int, hi: int, whole: int) -> DataFrame:
    return df if (lo, hi) == (0, whole) else df.where((F.col("pos") >= lo) & (F.col("pos") < hi))


def positions(df: DataFrame, lo: int, hi: int, length: int, whole: int) -> DataFrame:
    """Positions of the segments that hold lo..hi, as a range of pos, which reaches a Parquet scan."""
    if (lo, hi) == (0, whole):
        return df
    return df.where((F.col("pos") >= lo // length * length) & (F.col("pos") < (max(lo, hi - 1) // length + 1) * length))


def check_word(column: EncodedColumn, name: str = "word"):
    from ...types import word

    return word(column.param(name))


def anchor_bounds(anchors: DataFrame, lo: int, hi: int, length: int):
    """The anchors of the first segment of lo..hi and of the one behind the last (None where there is none): two rows."""
    ends = lo // length, max(lo, hi - 1) // length + 1
    found = {r["seg"]: r for r in anchors.where(F.col("seg").isin(*ends)).collect()}
    return tuple(found.get(s) for s in ends)


def expand_runs(runs: DataFrame, length: int, chunk: int) -> DataFrame:
    """(pos, value) of runs (start, end, value): each run is cut at multiples of chunk before it is expanded, and the
    pieces dealt out anew, so that a long run is many tasks' work and never one array."""
    runs = runs.select("value", F.col("start").cast("bigint").alias("start"), F.least(F.col("end").cast("bigint"), F.lit(length).cast("bigint")).alias("end")).where("end > start")
    pieces = runs.withColumn("seg", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}"))))
    pieces = pieces.select("seg", "value", F.greatest(F.col("start"), F.col("seg") * chunk).alias("start"), F.least(F.col("end"), (F.col("seg") + 1) * chunk).alias("end"))
    return pieces.repartition(F.col("seg")).select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def of_segment(df: DataFrame, length: int) -> Column:
    return F.expr(f"pos div {length}")
