"""Model: no data at all; values are a model of the position, of one for the column or one for each interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...functions.models import evaluate, literals
from ...types import EncodingError, wide, wrap
from .common import check_word, in_segments, window_of


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    of = check_word(column)
    lo, hi = window_of(column, lo, hi)
    spark = spark or SparkSession.getActiveSession()
    value = evaluate(column.param("model"), literals(list(column.param("model_coefficients", []))), F.col("id"))
    return spark.range(lo, hi).select(F.col("id").alias("pos"), wrap(wide(value, of), of).alias("value"))


def decode_intervals(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Each interval of modeling_period positions has coefficients c0, c1, ...; x is the position in the interval."""
    of, period = check_word(column), column.param("modeling_period")
    if period <= 0:
        raise EncodingError("model: the period must be positive")
    lo, hi = window_of(column, lo, hi)
    given = in_segments(column.part("interval_model_coefficients", "interval"), lo, hi, period, column.length, "interval")
    names = sorted((c for c in given.columns if c[0] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    # Each interval makes its own positions: no exchange and no join.
    first, last = F.greatest(F.col("interval") * period, F.lit(lo)), F.least((F.col("interval") + 1) * period, F.lit(hi)) - 1
    rows = given.where(last >= first).select("*", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("pos"))
    value = evaluate(column.param("model"), [F.col(c) for c in names], F.col("pos") - F.col("interval") * period)
    return rows.select("pos", wrap(wide(value, of), of).alias("value"))
