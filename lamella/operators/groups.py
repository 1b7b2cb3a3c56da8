"""Votes and hand-outs in groups: consecutive positions, length to a group, as (pos, value) columns. One shuffle by group each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import EncodingError
from .scan import seg


def votes(df: DataFrame, length: int, predicate: Callable[[Column], Column]) -> DataFrame:
    """One row a group: seg, tally (elements that satisfy the predicate), first (place in the group of the first one, length
    for none), and whether all, none or some do, and whether all agree. A null result is a vote against."""
    yes = F.coalesce(predicate(F.col("value")), F.lit(False))
    counts = df.select(seg(length).alias("seg"), F.col("pos") % length, yes).toDF("seg", "place", "yes").groupBy("seg")
    counts = counts.agg(F.count_if("yes").alias("tally"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("yes"), F.col("place"))).alias("at"))
    none, every = F.col("tally") == 0, F.col("tally") == F.col("n")
    return counts.select("seg", "tally", F.coalesce("at", F.lit(length)).cast("bigint").alias("first"), every.alias("all"), none.alias("none"), (~none).alias("some"), (none | every).alias("agree"))


def from_place(df: DataFrame, length: int, place: int | str) -> DataFrame:
    """(pos, value): every element takes the value that stands at a place of its group: "first", "last" or a number from 0.
    Groups too short for the number give null."""
    by = Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if place in ("first", "last"):
        got = (F.first if place == "first" else F.last)("value").over(by)
    elif isinstance(place, int) and 0 <= place < length:
        got = F.max(F.when(F.col("pos") % length == place, F.struct("value"))).over(Window.partitionBy("seg"))["value"]
    else:
        raise EncodingError(f"no place {place!r} in groups of {length}")
    return df.withColumn("seg", seg(length)).select("pos", got.alias("value"))


def fill(spark: SparkSession, length: int, value) -> DataFrame:
    """(pos, value): one value at all positions."""
    return spark.range(length).select(F.col("id").alias("pos"), F.lit(value).alias("value"))
