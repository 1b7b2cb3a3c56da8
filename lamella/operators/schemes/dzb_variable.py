"""Null suppression, variable width: each element's low bytes, its size in a packed field, byte offsets of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...encoded import EncodedColumn
from ...functions.bits import bit_subsequence
from ...types import EncodingError, Word
from ..layout import little_endian, swapped
from ..scan import exclusive_prefix
from .common import anchor_bounds, check_word, in_range, in_segments, of_segment, window_of


def _fields(container_size: int, bits: int) -> int:
    if container_size not in (4, 8):
        raise EncodingError("null suppression: containers of sizes have 4 or 8 bytes")
    if not 1 <= bits <= 4:
        raise EncodingError("null suppression: a size takes 1 to 4 bits")
    return 8 * container_size // bits


def encode(df: DataFrame, length: int, segment_length: int, of: Word, container_size: int = 4, least: int = 1, bits: int = 2, stream_bytes: int | None = None) -> EncodedColumn:
    """least: size that field 0 stands for; a value that needs fewer bytes takes it. stream_bytes: the data as one byte
    stream cut every so many bytes, in which the anchors say where segments begin; else a blob a segment."""
    per = _fields(container_size, bits)
    digits = F.conv(F.col("value").cast("decimal(20,0)").cast("string"), 10, 16)
    need = F.when(F.col("value") == 0, F.lit(0)).otherwise(F.expr("(length(d) + 1) div 2"))
    size = F.greatest(need, F.lit(least)).cast("int")
    size = F.when(size - least < 1 << bits, size).otherwise(F.raise_error(F.lit(f"null suppression: a size beyond {bits} bits")).cast("int"))
    rows = df.select("pos", "value", digits.alias("d")).withColumn("n", size).withColumn("seg", of_segment(df, segment_length))
    rows = rows.withColumn("b", F.when(F.col("n") == 0, F.lit("")).otherwise(F.substring(swapped(F.lpad("d", F.col("n") * 2, F.lit("0"))), F.lit(1), F.col("n") * 2)))
    blobs = rows.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("p"), F.sum("n").alias("total"))
    # Digits are joined once, then made bytes.
    blobs = blobs.select("seg", "total", F.unhex(F.array_join("p.b", "")).alias("bytes"))
    anchors = exclusive_prefix(blobs.select("seg", "total")).select("seg", F.coalesce("before", F.lit(0)).cast("bigint").alias("byte_offset"))
    held = blobs.select("seg", "bytes")
    if stream_bytes:
        held = _stream(blobs.join(anchors, "seg"), stream_bytes)
    field = F.call_function("shiftleft", (F.col("n") - least).cast("bigint"), F.expr(f"cast(pos % {per} as int) * {bits}"))
    words = rows.groupBy(F.expr(f"pos div {per}").alias("container")).agg(F.bit_or(field).alias("word"))
    params = {"segment_length": segment_length, "word": of.name, "container_size": container_size, "min_represented_element_size": least, "bits_per_element_size": bits} | ({"stream_bytes": stream_bytes} if stream_bytes else {})
    return EncodedColumn("dzb_variable", length, params, {"compressed_data": held, "packed_element_sizes": words, "position_anchors": anchors})


def _cut(df: DataFrame, size: int, most: str = "total") -> DataFrame:
    """A row for each chunk of size bytes that the stretch of `most` bytes from byte_offset on touches: chunk, and the
    places near..far of it in the chunk."""
    held = df.where(F.col(most) > 0).withColumn("chunk", F.explode(F.sequence(F.expr(f"byte_offset div {size}"), F.expr(f"(byte_offset + {most} - 1) div {size}"))))
    at = F.col("chunk") * size
    return held.withColumn("near", F.greatest(F.col("byte_offset") - at, F.lit(0))).withColumn("far", F.least(F.col("byte_offset") + F.col(most) - at, F.lit(size).cast("bigint")))


def _joined(pieces: str) -> Column:
    """Bytes of sorted (place, bytes) pieces, joined once."""
    return F.unhex(F.array_join(F.transform(F.col(pieces), lambda x: F.hex(x["bytes"])), ""))


def _stream(blobs: DataFrame, size: int) -> DataFrame:
    """(chunk, bytes) of segments' (bytes, total, byte_offset)."""
    cut = _cut(blobs, size)
    skipped = F.col("chunk") * size + F.col("near") - F.col("byte_offset")
    piece = F.substring("bytes", (skipped + 1).cast("int"), (F.col("far") - F.col("near")).cast("int"))
    return cut.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("near", piece.alias("bytes")))).alias("p")).select("chunk", _joined("p").alias("bytes"))


def _segment_blobs(column: EncodedColumn, sizes: DataFrame, lo: int, hi: int, n: int) -> DataFrame:
    """(seg, bytes) out of the byte stream: each segment's stretch begins at its anchor and has its sizes' sum. Of a part
    of the column the anchors give the first and the last chunk to read."""
    size, whole = column.param("stream_bytes"), (lo, hi) == (0, column.length)
    anchors, chunks = column.part("position_anchors", "seg", "byte_offset"), column.part("compressed_data", "chunk", "bytes")
    if not whole:
        first, upper = anchor_bounds(anchors, lo, hi, n)
        chunks = chunks.where(F.col("chunk") >= (first["byte_offset"] // size if first else 0))
        if upper:
            chunks = chunks.where(F.col("chunk") <= upper["byte_offset"] // size)
    totals = sizes.groupBy("seg").agg(F.sum("n").alias("total"))
    cut = _cut(totals.join(in_segments(anchors, lo, hi, n, column.length), "seg"), size).join(chunks, "chunk")
    piece = F.substring("bytes", (F.col("near") + 1).cast("int"), (F.col("far") - F.col("near")).cast("int"))
    got = cut.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("bytes")))).alias("p")).select("seg", _joined("p").alias("bytes"))
    # Segments of zero bytes have no stretch.
    return totals.select("seg").join(got, "seg", "left").select("seg", F.coalesce("bytes", F.lit(b"")).alias("bytes"))


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """compressed_data holds each segment's bytes, or a byte stream in which position_anchors say where segments begin
    (parameter stream_bytes): a task touches its segments' bytes only. Fields of 64-bit containers
    are read as unsigned; high bits beyond the last field mean nothing."""
    of, n = check_word(column), column.segment_length()
    least, bits = column.param("min_represented_element_size"), column.param("bits_per_element_size")
    per = _fields(column.param("container_size", 4), bits)
    lo, hi = window_of(column, lo, hi)
    words = column.part("packed_element_sizes", "container", "word")
    if (lo, hi) != (0, column.length):
        first, last = lo // n * n, min(column.length, (max(lo, hi - 1) // n + 1) * n)
        words = words.where(F.col("container").between(first // per, max(first, last - 1) // per))
    sizes = words.select("container", F.col("word").cast("bigint").alias("word"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    sizes = sizes.select((F.col("container") * per + F.col("k")).cast("bigint").alias("pos"), (bit_subsequence(F.col("word"), F.col("k") * bits, bits) + least).cast("int").alias("n")).where(F.col("pos") < column.length)
    sizes = sizes.withColumn("seg", of_segment(sizes, n))
    sizes = in_segments(sizes, lo, hi, n, column.length)
    streamed = "stream_bytes" in column.params
    blobs = _segment_blobs(column, sizes, lo, hi, n) if streamed else in_segments(column.part("compressed_data", "seg", "bytes"), lo, hi, n, column.length)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.withColumn("at", before.cast("int")).join(blobs, "seg")
    value = little_endian(F.substring("bytes", F.col("at") + 1, F.col("n")), F.col("n"))
    return in_range(rows.select("pos", value.cast(of.spark()).alias("value")), lo, hi, column.length)
