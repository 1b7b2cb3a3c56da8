"""Machine words: widths, Spark types, wrapping arithmetic, and the pickers of minimal widths that encoders use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EncodingError(ValueError):
    """Parts or parameters that don't describe an encoded column."""


@dataclass(frozen=True)
class Word:
    """A fixed-width integer. size is in bytes: 1, 2, 4 or 8 as stored; 3, 5, 6 and 7 exist for null suppression."""

    size: int
    signed: bool = False

    def __post_init__(self):
        if not 1 <= self.size <= 8:
            raise EncodingError(f"no word of {self.size} bytes")

    @property
    def bits(self) -> int:
        return 8 * self.size

    @property
    def low(self) -> int:
        return -(1 << (self.bits - 1)) if self.signed else 0

    @property
    def high(self) -> int:
        return (1 << (self.bits - 1 if self.signed else self.bits)) - 1

    @property
    def name(self) -> str:
        return ("i" if self.signed else "u") + str(self.bits)

    def spark(self) -> T.DataType:
        """Smallest Spark type that holds every value (Spark has no unsigned types)."""
        bits = self.bits if self.signed else self.bits + 1
        return T.ByteType() if bits <= 8 else T.ShortType() if bits <= 16 else T.IntegerType() if bits <= 32 else T.LongType() if bits <= 64 else T.DecimalType(20, 0)


U8, U16, U32, U64 = (Word(n) for n in (1, 2, 4, 8))
I8, I16, I32, I64 = (Word(n, True) for n in (1, 2, 4, 8))


def word(name: str) -> Word:
    """Word of a name such as "u16" or "i32"."""
    if name[:1] not in "ui" or not name[1:].isdigit() or int(name[1:]) % 8:
        raise EncodingError(f"no word named {name!r}")
    return Word(int(name[1:]) // 8, name[0] == "i")


def wide(col: Column, of: Word) -> Column:
    """The value in a type whose sums don't overflow: BIGINT for words up to 4 bytes, else DECIMAL(38, 0)."""
    return col.cast("bigint") if of.size <= 4 else col.cast("decimal(38,0)")


def wrap(col: Column, to: Word) -> Column:
    """A wide value reduced modulo 2^bits, as two's complement fixed-width arithmetic leaves it."""
    if to.size <= 4:
        m = F.lit(1 << to.bits).cast("bigint")
        x = F.pmod(col.cast("bigint"), m)
        half = F.lit(1 << (to.bits - 1)).cast("bigint")
    else:
        m = F.lit(str(1 << to.bits)).cast("decimal(38,0)")
        x = F.pmod(col.cast("decimal(38,0)"), m)
        half = F.lit(str(1 << (to.bits - 1))).cast("decimal(38,0)")
    if to.signed:
        x = F.when(x >= half, x - m).otherwise(x)
    return x.cast(to.spark())


def bytes_to_fit(n: int) -> int:
    """Bytes of the narrowest unsigned value that holds n (at least 1)."""
    return max(1, (int(n).bit_length() + 7) // 8)


def word_to_fit(low: int, high: int) -> Word:
    """Narrowest word of 1, 2, 4 or 8 bytes that holds low..high; unsigned where nothing is negative."""
    for size in (1, 2, 4, 8):
        w = Word(size, low < 0)
        if w.low <= low and high <= w.high:
            return w
    raise EncodingError(f"{low}..{high} needs more than 8 bytes")


def nearly_equal(x: Column, y: Column, tolerance: float = 1e-6) -> Column:
    """Relative comparison of floats."""
    x, y = x.cast("double"), y.cast("double")
    return F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y), F.lit(1e-300))
