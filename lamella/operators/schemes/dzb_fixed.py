"""Null suppression, fixed width: words whose high bytes are all zero, stored without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...encoded import EncodedColumn
from ...types import EncodingError, Word
from ..layout import swapped
from .common import check_word, in_range, window_of


def padded(data: Column, size: int, endianness: str = "little") -> Column:
    """BINARY of size bytes: the data with zeros at the end (little-endian) or in front (big-endian)."""
    side = F.rpad if endianness == "little" else F.lpad
    return F.unhex(side(F.hex(data), 2 * size, "0"))


def encode(df: DataFrame, length: int, of: Word, stored: Word, endianness: str = "little", binary: bool = False) -> EncodedColumn:
    """binary: the stored form is BINARY of stored's size instead of a number; only it has a byte order."""
    _check(of, stored, endianness)
    v = F.col("value").cast("decimal(20,0)")
    v = F.when((v >= 0) & (v <= F.lit(str(stored.high)).cast("decimal(20,0)")), v).otherwise(F.raise_error(F.lit(f"null suppression: a value beyond {stored.size} bytes")).cast("decimal(20,0)"))
    if binary:
        digits = F.lpad(F.conv(v.cast("string"), 10, 16), 2 * stored.size, "0")
        v = F.unhex(digits if endianness == "big" else swapped(digits))
    else:
        v = v.cast(stored.spark())
    return EncodedColumn("dzb_fixed", length, {"word": of.name, "stored": stored.name, "endianness": endianness}, {"compressed_input": df.select("pos", v.alias("v"))})


def _check(of: Word, stored: Word, endianness: str) -> None:
    if of.size <= stored.size:
        raise EncodingError("null suppression: values must be wider than what is stored")
    if endianness not in ("little", "big"):
        raise EncodingError(f"no byte order {endianness!r}")


def decode(column: EncodedColumn, lo: int | None = None, hi: int | None = None) -> DataFrame:
    of, stored, order = check_word(column), check_word(column, "stored"), column.param("endianness", "little")
    _check(of, stored, order)
    lo, hi = window_of(column, lo, hi)
    rows = in_range(column.part("compressed_input", "pos", "v"), lo, hi, column.length)
    v = F.col("v")
    if isinstance(rows.schema["v"].dataType, T.BinaryType):
        v = F.conv(F.hex(v) if order == "big" else swapped(F.hex(v)), 16, 10).cast("decimal(20,0)")
    elif stored.size <= 4:
        v = v.cast("bigint").bitwiseAND(F.lit(stored.high))
    return rows.select("pos", v.cast(of.spark()).alias("value"))
