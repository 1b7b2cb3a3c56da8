"""Segmented reductions and prefix scans of (pos, value) columns.

A window over the whole column would run in one task, so scans of a column take totals of segments first, prefixes of
the totals in two more levels (4096 segments to a group), and a window inside each segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import neutral
from ..types import EncodingError, Word, wide, wrap

FAN = 4096

#: name -> (aggregate, combination of two results)
OPS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "product": (None, lambda a, b: a * b),
    "bit_and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "logical_and": (F.bool_and, lambda a, b: a & b),
    "logical_or": (F.bool_or, lambda a, b: a | b),
}


def _op(name: str):
    if name not in OPS:
        raise EncodingError(f"no reduction {name!r}")
    return OPS[name]


def seg(length: int, pos: str = "pos") -> Column:
    if not isinstance(length, int) or length <= 0:
        raise EncodingError(f"segment length must be a positive integer, not {length!r}")
    return F.expr(f"{pos} div {length}")


def times(of: Word | None) -> Callable[[Column, Column], Column]:
    """Product of two wide values: modulo the word, or exact in DECIMAL(38, 0), where an overflow is an error."""
    if of is None:
        return lambda a, b: (a.cast("decimal(38,0)") * b.cast("decimal(38,0)")).cast("decimal(38,0)")
    word = Word(of.size)  # unsigned in between; the sign comes with the last wrap
    if of.size <= 4:
        return lambda a, b: wrap((wrap(a, word).cast("decimal(11,0)") * wrap(b, word).cast("decimal(11,0)")).cast("decimal(38,0)") % F.lit(1 << of.bits).cast("decimal(11,0)"), word).cast("bigint")
    half, m = F.lit(1 << 32).cast("decimal(20,0)"), F.lit(str(1 << of.bits)).cast("decimal(38,0)")

    def mul(a: Column, b: Column) -> Column:
        # a * b = a_low * b + ((a_high * b) mod 2^32) * 2^32 and so on: every part stays under 2^97.
        a, b = wrap(a, word).cast("decimal(20,0)"), wrap(b, word).cast("decimal(20,0)")
        low = lambda x: F.pmod(x, half).cast("decimal(10,0)")
        high = lambda x: F.floor(x / half).cast("decimal(10,0)")
        cross = F.pmod((low(a) * high(b)).cast("decimal(21,0)") + (high(a) * low(b)).cast("decimal(21,0)"), half).cast("decimal(10,0)")
        return F.pmod((low(a) * low(b)).cast("decimal(38,0)") + (cross * half).cast("decimal(38,0)"), m).cast("decimal(38,0)")

    return mul


def _over(name: str, col: Column, window=None) -> Column:
    """The aggregate, plain or over a window."""
    agg, _ = _op(name)
    return agg(col) if window is None else agg(col).over(window)


def _few_products(col: Column, of: Word | None) -> Column:
    """Aggregate for groups of a bounded number of values: their product, by a fold."""
    return F.aggregate(F.collect_list(col.cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"), lambda a, v: times(of)(a, v).cast("decimal(38,0)"))


def _running_products(rows: DataFrame, col: str, key: str, order: str, most: int, of: Word | None) -> DataFrame:
    """rows with own, the inclusive product by key of at most `most` rows: doubling steps over one sorted partition, in
    each of which a row takes in the product that ends where its own begins."""
    by, out = Window.partitionBy(key).orderBy(order), rows.withColumn("own", F.col(col).cast("decimal(38,0)"))
    step = 1
    while step < most:
        out = out.withColumn("own", times(of)(F.col("own"), F.coalesce(F.lag("own", step).over(by), F.lit(1).cast("decimal(38,0)"))).cast("decimal(38,0)"))
        step *= 2
    return out


def _with_running(rows: DataFrame, op: str, length: int, inclusive: bool, of: Word | None) -> DataFrame:
    """rows (seg, pos, value) with own, the prefix in the segment; null for an exclusive scan's first."""
    by = Window.partitionBy("seg").orderBy("pos")
    if op != "product":
        return rows.withColumn("own", _running(op, F.col("value"), by, inclusive))
    out = _running_products(rows, "value", "seg", "pos", length, of)
    return out if inclusive else out.withColumn("own", F.lag("own").over(by))


def _totals(rows: DataFrame, op: str, length: int, of: Word | None) -> DataFrame:
    """(seg, total)"""
    if op != "product":
        return rows.groupBy("seg").agg(_over(op, F.col("value")).alias("total"))
    return _running_products(rows, "value", "seg", "pos", length, of).groupBy("seg").agg(F.max_by("own", "pos").alias("total"))


def _prepared(df: DataFrame, op: str, pre: Callable | None, of: Word | None) -> DataFrame:
    value = F.col("value") if pre is None else pre(F.col("pos"), F.col("value"))
    return df.select("pos", (wide(value, of) if of and op in ("sum", "product") else value).alias("value"))


def _done(col: Column, op: str, of: Word | None) -> Column:
    return wrap(col, of) if of and op in ("sum", "product") else col


def segmented_reduce(df: DataFrame, length: int, op: str, pre: Callable | None = None, of: Word | None = None, segments: int | None = None) -> DataFrame:
    """(seg, value): each segment's reduction. pre maps (pos, value) first. of: sums and products wrap as that word.

    segments: also gives segments without rows, with the operation's neutral value.
    """
    out = _totals(_prepared(df, op, pre, of).withColumn("seg", seg(length)), op, length, of).select("seg", _done(F.col("total"), op, of).alias("value"))
    if segments is None:
        return out
    kind = out.schema["value"].dataType
    empty = F.lit(neutral(op, of))
    return df.sparkSession.range(segments).withColumnRenamed("id", "seg").join(out, "seg", "left").withColumn("value", F.coalesce("value", empty.cast(kind)))


def _running(op: str, col: Column, by, inclusive: bool) -> Column:
    return _over(op, col, by.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def segment_scan(df: DataFrame, length: int, op: str = "sum", inclusive: bool = True, pre: Callable | None = None, of: Word | None = None) -> DataFrame:
    """(pos, value): prefix reduction inside each segment; an exclusive scan starts with the neutral value."""
    rows = _prepared(df, op, pre, of).withColumn("seg", seg(length))
    return _with_running(rows, op, length, inclusive, of).select("pos", _done(F.coalesce("own", F.lit(neutral(op, of))), op, of).alias("value"))


def exclusive_prefix(totals: DataFrame, op: str = "sum", levels: int = 2, of: Word | None = None) -> DataFrame:
    """(seg, total) to (seg, before): reduction of all earlier segments, null for none."""
    _, combine = _op(op)
    if op == "product":
        combine = times(of)
    if not levels:  # one row for each FAN * FAN segments
        by = Window.partitionBy(F.lit(0)).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        if op == "product":
            before = F.aggregate(F.collect_list(F.col("total").cast("decimal(38,0)")).over(by), F.lit(1).cast("decimal(38,0)"), lambda a, v: times(of)(a, v).cast("decimal(38,0)"))
            return totals.select("seg", before.alias("before"))
        return totals.select("seg", _over(op, F.col("total"), by).alias("before"))
    rows = totals.withColumn("grp", F.expr(f"seg div {FAN}"))
    if op == "product":
        held = _running_products(rows, "total", "grp", "seg", FAN, of)
        groups = held.groupBy(F.col("grp").alias("seg")).agg(F.max_by("own", "seg").alias("total"))
        rows = held.withColumn("own", F.lag("own").over(Window.partitionBy("grp").orderBy("seg")))
    else:
        groups = rows.groupBy(F.col("grp").alias("seg")).agg(_over(op, F.col("total")).alias("total"))
        rows = rows.withColumn("own", _running(op, F.col("total"), Window.partitionBy("grp").orderBy("seg"), False))
    upper = exclusive_prefix(groups, op, levels - 1, of).select(F.col("seg").alias("grp"), F.col("before").alias("up"))
    both = F.when(F.col("own").isNull(), F.col("up")).when(F.col("up").isNull(), F.col("own")).otherwise(combine(F.col("own"), F.col("up")))
    return rows.join(upper, "grp").select("seg", both.alias("before"))


def two_phase_scan(df: DataFrame, length: int, op: str = "sum", inclusive: bool = True, pre: Callable | None = None, of: Word | None = None) -> DataFrame:
    """(pos, value): prefix reduction over the whole column, by segments of the given length."""
    _, combine = _op(op)
    if op == "product":
        combine = times(of)
    rows = _prepared(df, op, pre, of).withColumn("seg", seg(length))
    before = exclusive_prefix(_totals(rows, op, length, of), op, of=of)
    both = F.when(F.col("own").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("own")).otherwise(combine(F.col("own"), F.col("before")))
    return _with_running(rows, op, length, inclusive, of).join(before, "seg").select("pos", _done(F.coalesce(both, F.lit(neutral(op, of))), op, of).alias("value"))


def scan_and_reduce(df: DataFrame, length: int, op: str = "sum", inclusive: bool = True, of: Word | None = None) -> DataFrame:
    """(pos, value, total): prefix in the segment, and the segment's reduction, for every element."""
    rows = _with_running(_prepared(df, op, None, of).withColumn("seg", seg(length)), op, length, True if op == "product" else inclusive, of)
    by = Window.partitionBy("seg")
    total = F.last("own").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if op == "product" else _over(op, F.col("value"), by)
    own = F.col("own") if inclusive or op != "product" else F.lag("own").over(by.orderBy("pos"))
    return rows.select("pos", _done(F.coalesce(own, F.lit(neutral(op, of))), op, of).alias("value"), _done(total, op, of).alias("total"))


def elementwise(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.select("pos", f(F.col("value")).alias("value"))


def elementwise_accumulate(x: DataFrame, y: DataFrame, op: str) -> DataFrame:
    """x combined with y at the same positions; positions that only one of them has keep their value."""
    return x.select("pos", "value").unionByName(y.select("pos", "value")).groupBy("pos").agg((_few_products(F.col("value"), None) if op == "product" else _over(op, F.col("value"))).alias("value"))


def multisearch(needles: DataFrame, straws: DataFrame) -> DataFrame:
    """(pos, needle, found): smallest straw above each needle, null for none.

    needles: (pos, value); straws: (value). Distinct values of both are sorted in ranges; each range knows the first
    straw of the next ones, so no needle meets all straws.
    """
    spark = needles.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = needles.select(F.col("value").alias("v"), F.lit(0).alias("straw")).unionByName(straws.select(F.col("value").alias("v"), F.lit(1).alias("straw"))).groupBy("v").agg(F.max("straw").alias("straw"))
    ranged = both.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id())
    firsts = ranged.where("straw = 1").groupBy("part").agg(F.min("v").alias("lo"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("part"))
    later = parts.join(firsts, "part", "left").select("part", F.min("lo").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    own = F.min(F.when(F.col("straw") == 1, F.col("v"))).over(Window.partitionBy("part").orderBy("v").rowsBetween(1, Window.unboundedFollowing))
    found = ranged.withColumn("own", own).join(F.broadcast(later), "part").select(F.col("v").alias("value"), F.coalesce("own", "next").alias("found"))
    return needles.select("pos", "value").join(found, "value").select("pos", F.col("value").alias("needle"), "found")
