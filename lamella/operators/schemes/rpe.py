"""Run-position encoding: values and first positions of runs, absolute or relative to the segment where a run begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...types import EncodingError, Word
from .common import anchor_bounds, check_word, expand_runs, in_range, window_of
from .rle import segment_runs


def encode(df: DataFrame, length: int, segment_length: int, stored: Word, relative: bool = False) -> EncodedColumn:
    runs = segment_runs(df, segment_length)
    start = F.expr(f"start % {segment_length}") if relative else F.col("start")
    fits = F.when(start <= min(stored.high, 1 << 62), start).otherwise(F.raise_error(F.lit(f"run position beyond {stored.name}")).cast("bigint"))
    anchors = runs.groupBy("seg").agg(F.min("run").alias("run"))
    params = {"segment_length": segment_length, "positions": stored.name, "relative": relative}
    return EncodedColumn("rpe", length, params, {"runs": runs.select("run", "value", fits.cast(stored.spark()).alias("start")), "anchors": anchors})


def absolute(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(run, value, start) with absolute starts. With lo and hi, only the runs that reach into lo..hi and the next one;
    the first of them may be given as starting with its segment.

    Of relative ones: runs after anchor s - 1 up to anchor s begin in the half-open stretch that ends with segment s's
    first position, so a relative start of 0 is that position, and any other counts from segment s - 1.
    """
    runs, n, part = column.part("runs", "run", "value", "start"), column.segment_length(), lo is not None
    relative = column.params.get("relative")
    if not relative and "positions" in column.params and check_word(column, "positions").size < column.params.get("index_size", 1):
        raise EncodingError("absolute run positions are narrower than the index")
    anchors, first = column.part("anchors", "seg", "run") if relative or "anchors" in column.parts else None, None
    if part and anchors is not None:
        first, upper = anchor_bounds(anchors, lo, hi, n)
        runs = runs.where(F.col("run") >= (first["run"] if first else 0))
        if upper:
            runs = runs.where(F.col("run") <= upper["run"])
    elif part:  # the last run that starts at or before lo, by a scan of two columns with the filter pushed down
        at = runs.where(F.col("start") <= lo).agg(F.max("run").alias("run")).first()["run"]
        after = runs.where(F.col("start") >= hi).agg(F.min("run").alias("run")).first()["run"]
        runs = runs.where(F.col("run") >= (at or 0))
        runs = runs if after is None else runs.where(F.col("run") <= after)
    if not relative:
        return runs.select("run", "value", F.col("start").cast("bigint").alias("start"))
    if part:
        anchors = anchors.where(F.col("seg").between(lo // n, max(lo, hi - 1) // n + 1))
    earlier = anchors.select((F.col("seg") + 1).alias("seg"), F.col("run").alias("prev"))
    spans = anchors.join(earlier, "seg", "left").select("seg", F.coalesce(F.col("prev") + 1, F.lit(first["run"] if first else 0)).alias("first"), F.col("run").alias("last"))
    tail = anchors.agg((F.max("seg") + 1).alias("seg"), (F.max_by("run", "seg") + 1).alias("first")).crossJoin(F.broadcast(runs.agg(F.max("run").alias("last"))))  # one row each
    spans = spans.unionByName(tail).where("last >= first")
    placed = spans.select("seg", F.explode(F.sequence("first", "last")).alias("run")).join(runs, "run")
    rel = F.col("start").cast("bigint")
    start = F.when(rel == 0, F.col("seg") * n).otherwise((F.col("seg") - 1) * n + rel)
    if first:
        start = F.when(F.col("run") == first["run"], F.lit(lo // n * n)).otherwise(start)
    return placed.select("run", "value", start.alias("start"))


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """A run's end is the next run's start, found by its number: no window over all runs."""
    n = column.segment_length()
    lo, hi = window_of(column, lo, hi)
    whole = (lo, hi) == (0, column.length)
    runs = absolute(column) if whole else absolute(column, lo, hi)
    following = runs.select((F.col("run") - 1).alias("run"), F.col("start").alias("end"))
    placed = runs.join(following, "run", "left").withColumn("end", F.coalesce("end", F.lit(column.length)))
    if not whole:
        placed = placed.where((F.col("end") > lo) & (F.col("start") < hi)).withColumn("start", F.greatest("start", F.lit(lo // n * n)))
    return in_range(expand_runs(placed, column.length, n), lo, hi, column.length)
