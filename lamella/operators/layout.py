"""Data movement by position: gather, scatter and scatter by compressed indices; the latter two are how columns are patched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import EncodingError
from .scan import exclusive_prefix, seg


def swapped(digits: Column, most: int = 8) -> Column:
    """Hexadecimal digits with their bytes in reverse order, of up to most bytes. (Spark's reverse makes a string of a
    BINARY, which spoils bytes.)"""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(most))])


def little_endian(data: Column, size: Column | int) -> Column:
    """Unsigned little-endian number in the first size bytes (at most 8) of a BINARY, as DECIMAL(20, 0); 0 for no bytes."""
    digits = swapped(F.hex(F.substring(data, F.lit(1), size if isinstance(size, Column) else F.lit(size))))
    return F.when(F.length(digits) == 0, F.lit("0")).otherwise(F.conv(digits, 16, 10)).cast("decimal(20,0)")


def gather(data: DataFrame, indices: DataFrame, strict: bool = True) -> DataFrame:
    """(pos, value) with value = data's value at idx. data: (pos, value); indices: (pos, idx).

    strict: an index outside data is an error, else it gives null.
    """
    found = indices.select("pos", "idx").join(data.select(F.col("pos").alias("idx"), "value", F.lit(True).alias("_in")), "idx", "left")
    value = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("gather: no element at "), F.col("idx").cast("string")))).otherwise(F.col("value")) if strict else F.col("value")
    return found.select("pos", value.alias("value"))


def scatter(target: DataFrame, patch: DataFrame) -> DataFrame:
    """target (pos, value) with the patch's values at its positions. Two values for one position are an error; positions
    outside target have no effect."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("scatter: several values for position "), F.first("pos").cast("string")))).otherwise(F.first("value"))
    new = patch.groupBy("pos").agg(one.alias("_new"))
    kind = target.schema["value"].dataType
    return target.select("pos", "value").join(new, "pos", "left").select("pos", F.coalesce(F.col("_new").cast(kind), F.col("value")).alias("value"))


def resolve_compressed_scatter(data_length: int, anchoring_period: int) -> None:
    """Parameters of a compressed-indices scatter that can't be laid out are errors."""
    if data_length <= 0:
        raise EncodingError("compressed scatter: no data to scatter")
    if anchoring_period <= 0:
        raise EncodingError("compressed scatter: the anchoring period must be positive")


def run_starts(runs: DataFrame, anchors: DataFrame | None = None, period: int | None = None) -> DataFrame:
    """runs (run, length, ...) with start: index of the run's first data item.

    With anchors (i, run: first run of the i-th period of data items; runs break there), starts are sums inside a period;
    without, sums over all runs in levels.
    """
    if anchors is None:
        rows = runs.withColumn("seg", seg(4096, "run"))
        before = exclusive_prefix(rows.groupBy("seg").agg(F.sum("length").alias("total")))
        own = F.sum("length").over(Window.partitionBy("seg").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_own", own).join(before, "seg").withColumn("start", F.coalesce("_own", F.lit(0)) + F.coalesce("before", F.lit(0))).drop("seg", "_own", "before")
    following = anchors.select((F.col("i") - 1).alias("i"), F.col("run").alias("next"))
    last = runs.agg(F.max("run").alias("_last"))
    spans = anchors.join(following, "i", "left").crossJoin(F.broadcast(last))  # one row: the number of runs
    upto = F.coalesce(F.col("next") - 1, F.col("_last"))
    spans = spans.where(upto >= F.col("run")).select("i", F.explode(F.sequence("run", upto)).alias("run"))
    own = F.sum("length").over(Window.partitionBy("i").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return runs.join(spans, "run").withColumn("start", F.coalesce(own, F.lit(0)) + F.col("i") * period).drop("i")


def compressed_positions(runs: DataFrame, offset_bytes: DataFrame, index_size: int = 4, chunk_bytes: int | None = None, anchors: DataFrame | None = None, period: int | None = None) -> DataFrame:
    """(p, pos): output position of each data item.

    runs: run, length, offset_bits (8, 16, 32 or 64; others are errors), baseline, offsets_start (in units of index_size
    bytes). offset_bytes: (chunk, bytes), a byte sequence cut into pieces of chunk_bytes (None: one piece, chunk 0).
    """
    runs = runs.where("length > 0")
    width = F.when(F.col("offset_bits").isin(8, 16, 32, 64), F.expr("offset_bits div 8")).otherwise(F.raise_error(F.concat(F.lit("compressed scatter: offsets of "), F.col("offset_bits").cast("string"), F.lit(" bits"))).cast("bigint"))
    runs = run_starts(runs, anchors, period).withColumn("_w", width).withColumn("_from", F.col("offsets_start").cast("bigint") * index_size)
    c = chunk_bytes or (1 << 62)
    first, last = F.expr(f"_from div {c}"), F.expr(f"(_from + length * _w - 1) div {c}")
    held = runs.withColumn("chunk", F.explode(F.sequence(first, last))).join(offset_bytes.select("chunk", "bytes"), "chunk")
    near = F.greatest(F.col("_from") - F.col("chunk") * c, F.lit(0)) if chunk_bytes else F.col("_from")
    far = F.col("_from") + F.col("length") * F.col("_w") - (F.col("chunk") * c if chunk_bytes else F.lit(0))
    piece = F.substring("bytes", (near + 1).cast("int"), (far - near).cast("int"))
    whole = held.withColumn("_piece", piece).groupBy("run", "length", "_w", "baseline", "start").agg(F.array_sort(F.collect_list(F.struct("chunk", "_piece"))).alias("_p"))
    data = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["_piece"]))
    items = whole.select("start", "baseline", "_w", data.alias("_d"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("k"))
    offset = little_endian(F.substring("_d", (F.col("k") * F.col("_w") + 1).cast("int"), F.col("_w").cast("int")), F.col("_w").cast("int"))
    return items.select((F.col("start") + F.col("k")).alias("p"), (F.col("baseline") + offset).cast("bigint").alias("pos"))


def compressed_indices_scatter(target: DataFrame, data: DataFrame, runs: DataFrame, offset_bytes: DataFrame, **layout) -> DataFrame:
    """target with data (p, value) at the positions that runs describe. No runs: target as it is."""
    patch = compressed_positions(runs, offset_bytes, **layout).join(data.select("p", "value"), "p").select("pos", "value")
    return scatter(target, patch)


def compress_indices(patch: DataFrame, period: int = 1024, index_size: int = 4) -> dict[str, DataFrame]:
    """Parts of a compressed patch of (pos, value): data, runs, offset_bytes (a chunk a run), anchors.

    Items are numbered by position; each period of items is a run with the narrowest offsets, and an anchor. The sorted
    items are kept in Spark's cache (a patch is small beside its column), as all four parts are made of them. They are
    numbered in segments of 4096 positions and not in ranges of a sample, which a second reader might draw otherwise.
    """
    rows = patch.select("pos", "value").withColumn("seg", seg(4096, "pos"))
    before = exclusive_prefix(rows.groupBy("seg").agg(F.count(F.lit(1)).alias("total")))
    p = F.row_number().over(Window.partitionBy("seg").orderBy("pos")) - 1 + F.coalesce("before", F.lit(0))
    items = rows.join(before, "seg").select(p.cast("bigint").alias("p"), "pos", "value").withColumn("run", F.expr(f"p div {period}")).persist()
    runs = items.groupBy("run").agg(F.count(F.lit(1)).alias("length"), F.min("pos").alias("baseline"), F.max("pos").alias("_top"), F.array_sort(F.collect_list("pos")).alias("_all"))
    span = F.col("_top") - F.col("baseline")
    runs = runs.withColumn("offset_bits", F.when(span < 1 << 8, 8).when(span < 1 << 16, 16).when(span < 1 << 32, 32).otherwise(64))
    digits = F.transform("_all", lambda x: F.unhex(swapped(F.lpad(F.hex(x - F.col("baseline")), F.expr("cast(offset_bits div 4 as int)"), F.lit("0")))))
    runs = runs.withColumn("_bytes", F.aggregate(digits, F.lit(b""), lambda a, x: F.concat(a, x)))
    # Every run's bytes fill a chunk of the widest size, so starts need no sum.
    chunk = period * 8
    runs = runs.withColumn("offsets_start", F.expr(f"run * {chunk} div {index_size}"))
    return {
        "data": items.select("p", "value"),
        "runs": runs.select("run", "length", "offset_bits", "baseline", "offsets_start"),
        "offset_bytes": runs.select(F.col("run").alias("chunk"), F.col("_bytes").alias("bytes")),
        "anchors": runs.select(F.col("run").alias("i"), "run"),
    }


def append(*fragments: DataFrame) -> DataFrame:
    """Concatenation of fragments, in no particular order."""
    out = fragments[0]
    for f in fragments[1:]:
        out = out.unionByName(f)
    return out
