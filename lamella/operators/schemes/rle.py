"""Run-length encoding: values and lengths of runs; anchors name the run and the place in it where a segment begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...types import Word
from ..layout import run_starts
from ..scan import exclusive_prefix
from .common import anchor_bounds, expand_runs, in_range, in_segments, of_segment, window_of


def segment_runs(df: DataFrame, segment_length: int) -> DataFrame:
    """(seg, run, start, length, value): runs of equal neighbours in each segment, numbered through the column."""
    by = Window.partitionBy("seg").orderBy("pos")
    rows = df.select("pos", "value").withColumn("seg", of_segment(df, segment_length))
    new = F.when(F.row_number().over(by) == 1, True).otherwise(~F.col("value").eqNullSafe(F.lag("value").over(by)))
    rows = rows.withColumn("own", new)
    rows = rows.withColumn("own", F.sum(F.col("own").cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("seg", "own").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"), F.min_by("value", "pos").alias("value"))
    before = exclusive_prefix(runs.groupBy("seg").agg(F.max("own").alias("total")))
    return runs.join(before, "seg").select("seg", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).alias("run"), "start", "length", "value")


def encode(df: DataFrame, length: int, segment_length: int, lengths: Word) -> EncodedColumn:
    """Runs end at segments, so no anchor stands inside a run. A run longer than lengths holds is an error; segments of
    at most that many elements have none."""
    runs = segment_runs(df, segment_length)
    fits = F.when(F.col("length") <= min(lengths.high, 1 << 62), F.col("length")).otherwise(F.raise_error(F.lit(f"run length beyond {lengths.name}")).cast("bigint"))
    anchors = runs.groupBy("seg").agg(F.min("run").alias("run"), F.lit(0).cast("bigint").alias("intra_run_offset"))
    return EncodedColumn("rle", length, {"segment_length": segment_length, "lengths": lengths.name}, {"runs": runs.select("run", "value", fits.cast(lengths.spark()).alias("length")), "anchors": anchors})


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """With anchors, runs meet the segments they reach, and sums stay inside a segment; of a part of the column the anchors
    give the first and the last run, so no others are read. Without anchors, starts are sums over all runs, in levels."""
    n = column.segment_length()
    lo, hi = window_of(column, lo, hi)
    runs = column.part("runs", "run", "value", "length").withColumn("length", F.col("length").cast("bigint"))
    if "anchors" not in column.parts:
        placed = run_starts(runs.where("length > 0")).withColumn("end", F.col("start") + F.col("length"))
        if (lo, hi) != (0, column.length):
            placed = placed.where((F.col("end") > lo) & (F.col("start") < hi))
        return in_range(expand_runs(placed, column.length, n), lo, hi, column.length)
    anchors = column.part("anchors", "seg", "run", "intra_run_offset")
    if (lo, hi) != (0, column.length):
        first, upper = anchor_bounds(anchors, lo, hi, n)
        runs = runs.where(F.col("run") >= (first["run"] if first else 0))
        if upper:
            runs = runs.where(F.col("run") <= upper["run"])
    following = anchors.select((F.col("seg") - 1).alias("seg"), F.col("run").alias("next"), F.col("intra_run_offset").alias("next_offset"))
    spans = in_segments(anchors, lo, hi, n, column.length).join(following, "seg", "left")
    last = runs.agg(F.max("run").alias("_last"))
    # A segment's last run is the next one's first where that begins inside the run.
    upto = F.coalesce(F.when(F.col("next_offset") > 0, F.col("next")).otherwise(F.col("next") - 1), F.col("_last"))
    spans = spans.crossJoin(F.broadcast(last)).where(upto >= F.col("run"))  # one row: the last run's number
    met = spans.select("seg", F.col("run").alias("first"), "intra_run_offset", F.explode(F.sequence("run", upto)).alias("run")).join(runs, "run")
    size = F.col("length") - F.when(F.col("run") == F.col("first"), F.col("intra_run_offset").cast("bigint")).otherwise(0)
    met = met.withColumn("size", size)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("seg").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("seg") * n + before
    pieces = met.select("value", start.alias("start"), F.least(start + F.col("size"), (F.col("seg") + 1) * n, F.lit(column.length)).alias("end")).where("end > start")
    return in_range(pieces.select(F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value"), lo, hi, column.length)


def aggregate_encoded(column: EncodedColumn) -> DataFrame:
    """(count, sum, min, max) of an encoded numeric column, without expanding it."""
    runs = column.part("runs", "value", "length").where("length > 0")
    n, v = F.col("length").cast("decimal(38,0)"), F.col("value")
    return runs.agg(F.sum(n).cast("bigint").alias("count"), F.sum(n * v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
