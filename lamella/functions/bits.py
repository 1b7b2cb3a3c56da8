"""Bit functions of words of w bits (8, 16, 32 or 64) held in BIGINT: non-negative below 64 bits, two's complement at 64."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column) -> Column:
    return x.cast("bigint")


def one_bits(k: int) -> int:
    """The k lowest bits set, as a signed 64-bit literal."""
    return -1 if k >= 64 else (1 << k) - 1


def mask(x: Column, w: int) -> Column:
    return _long(x) if w == 64 else _long(x).bitwiseAND(F.lit(one_bits(w)))


def _n(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(int(n))


def shift_left(x: Column, n, w: int = 64) -> Column:
    """Bits beyond the word are lost; n from 0 to w - 1."""
    return mask(F.call_function("shiftleft", _long(x), _n(n)), w)


def shift_right(x: Column, n, w: int = 64) -> Column:
    """Zeros come in from above."""
    return F.call_function("shiftrightunsigned", mask(x, w), _n(n))


def bit_and(x: Column, y) -> Column:
    return _long(x).bitwiseAND(y)


def bit_or(x: Column, y) -> Column:
    return _long(x).bitwiseOR(y)


def bit_xor(x: Column, y) -> Column:
    return _long(x).bitwiseXOR(y)


def bit_not(x: Column, w: int = 64) -> Column:
    return mask(F.bitwise_not(_long(x)), w)


def rotate_left(x: Column, n: int, w: int) -> Column:
    n %= w
    return mask(x, w) if not n else shift_left(x, n, w).bitwiseOR(shift_right(x, w - n, w))


def rotate_right(x: Column, n: int, w: int) -> Column:
    return rotate_left(x, w - n % w, w)


def population_count(x: Column, w: int = 64) -> Column:
    return F.bit_count(mask(x, w))


def parity(x: Column, w: int = 64) -> Column:
    return population_count(x, w) % 2


def find_last_set(x: Column, w: int = 64) -> Column:
    """1-based place of the highest set bit, 0 for none."""
    x = mask(x, w)
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def find_first_set(x: Column, w: int = 64) -> Column:
    """1-based place of the lowest set bit, 0 for none."""
    return find_last_set(keep_only_lowest_bit(x, w), w)


def keep_only_lowest_bit(x: Column, w: int = 64) -> Column:
    """x & ~(x - 1), with the subtraction kept off 0 and off the lowest 64-bit value."""
    x = mask(x, w)
    least = F.lit(-(1 << 63))
    safe = F.when((x == 0) | (x == least), F.lit(1).cast("bigint")).otherwise(x)
    return F.when((x == 0) | (x == least), x).otherwise(safe.bitwiseAND(F.bitwise_not(safe - 1)))


def keep_only_highest_bit(x: Column, w: int = 64) -> Column:
    n = find_last_set(x, w)
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(shift_left(F.lit(1), F.greatest(n - 1, F.lit(0))))


def count_trailing_zeros(x: Column, w: int = 64) -> Column:
    """-1 for 0"""
    return find_first_set(x, w) - 1


def count_leading_zeros(x: Column, w: int = 64) -> Column:
    return F.lit(w) - find_last_set(x, w)


def ilog2(x: Column, w: int = 64) -> Column:
    """-1 for 0"""
    return find_last_set(x, w) - 1


def reverse_bits(x: Column, w: int = 32) -> Column:
    """Swaps ever larger neighbours: bits, pairs, nibbles, ..."""
    x, n = mask(x, w), 1
    while n < w:
        low = sum(one_bits(n) << i for i in range(0, w, 2 * n))
        low = low - (1 << 64) if low >> 63 else low
        x = shift_left(x.bitwiseAND(F.lit(low)), n, w).bitwiseOR(shift_right(x, n, w).bitwiseAND(F.lit(low)))
        n *= 2
    return x


def byte_swap(x: Column, w: int) -> Column:
    out = F.lit(0).cast("bigint")
    for k in range(0, w, 8):
        out = out.bitwiseOR(shift_left(shift_right(x, k, w).bitwiseAND(F.lit(255)), w - 8 - k, w))
    return out


def keep_single_bit(x: Column, k: int, w: int = 64) -> Column:
    return mask(x, w).bitwiseAND(shift_left(F.lit(1), k))


def keep_bits_before(x: Column, k: int, w: int = 64) -> Column:
    return mask(x, w).bitwiseAND(F.lit(one_bits(k)))


def keep_bits_up_to(x: Column, k: int, w: int = 64) -> Column:
    return keep_bits_before(x, k + 1, w)


def keep_bits_starting_from(x: Column, k: int, w: int = 64) -> Column:
    return mask(x, w).bitwiseAND(F.lit(~one_bits(k) if k < 64 else 0))


def keep_bits_after(x: Column, k: int, w: int = 64) -> Column:
    return keep_bits_starting_from(x, k + 1, w)


def find_first_set_starting_from(x: Column, k: int, w: int = 64) -> Column:
    return find_first_set(keep_bits_starting_from(x, k, w), w)


def find_first_set_after(x: Column, k: int, w: int = 64) -> Column:
    return find_first_set(keep_bits_after(x, k, w), w)


def find_last_set_up_to(x: Column, k: int, w: int = 64) -> Column:
    return find_last_set(keep_bits_up_to(x, k, w), w)


def find_last_set_before(x: Column, k: int, w: int = 64) -> Column:
    return find_last_set(keep_bits_before(x, k, w), w)


lowest_k_bits = keep_bits_before
clear_higher_bits = keep_bits_before
clear_lower_bits = keep_bits_starting_from


def highest_k_bits(x: Column, k: int, w: int) -> Column:
    return shift_right(x, w - k, w) if k else F.lit(0).cast("bigint")


def clear_bit(x: Column, k: int, w: int = 64) -> Column:
    return mask(x, w).bitwiseAND(F.bitwise_not(shift_left(F.lit(1), k)))


def clear_lowest(x: Column, w: int = 64) -> Column:
    return mask(x, w).bitwiseXOR(keep_only_lowest_bit(x, w))


def bit_subsequence(x: Column, start, n: int, w: int = 64) -> Column:
    """n bits from place start on, as a number."""
    return shift_right(x, start, w).bitwiseAND(F.lit(one_bits(n)))


def insert_bits(x: Column, y: Column, start: int, n: int, w: int = 64) -> Column:
    """x with its n bits from start on replaced by the low bits of y."""
    hole = one_bits(n) << start
    hole = hole - (1 << 64) if hole >> 63 and hole > 0 else hole
    return mask(x, w).bitwiseAND(F.lit(~hole)).bitwiseOR(shift_left(_long(y).bitwiseAND(F.lit(one_bits(n))), start, w))


def round_down_to_power(x: Column, k: int) -> Column:
    """Down to a multiple of 2^k."""
    return _long(x).bitwiseAND(F.lit(~one_bits(k)))


def round_up_to_power(x: Column, k: int) -> Column:
    return round_down_to_power(_long(x) + one_bits(k), k)


def modulo_power(x: Column, k: int) -> Column:
    return _long(x).bitwiseAND(F.lit(one_bits(k)))


def next_power_of_2(x: Column) -> Column:
    """Smallest power of 2 that is at least x; 1 for x <= 1."""
    return F.when(x <= 1, F.lit(1).cast("bigint")).otherwise(shift_left(F.lit(1), find_last_set(F.greatest(_long(x) - 1, F.lit(0)))))


def is_power_of_2(x: Column) -> Column:
    return population_count(x) == 1


def multiply_high(x: Column, y: Column, w: int = 32) -> Column:
    """Upper half of the unsigned product; w is 32 or 64."""
    if w == 32:
        p = mask(x, 32).cast("decimal(20,0)") * mask(y, 32).cast("decimal(20,0)")
        return F.call_function("div", p, F.lit(1 << 32).cast("decimal(20,0)"))
    # Halves of 32 bits: all sums stay under 2^64, added in pieces.
    a, b, c, d = shift_right(x, 32), modulo_power(x, 32), shift_right(y, 32), modulo_power(y, 32)
    mul = lambda p, q: (p.cast("decimal(20,0)") * q.cast("decimal(20,0)")).cast("decimal(38,0)")
    k = F.lit(1 << 32).cast("decimal(38,0)")
    cut = lambda v: F.call_function("div", v, k).cast("decimal(38,0)")  # noqa: E731  a quotient by / is rounded to 6 places
    low = cut(mul(b, d)) + F.pmod(mul(a, d), k) + F.pmod(mul(b, c), k)
    high = mul(a, c) + cut(mul(a, d)) + cut(mul(b, c)) + cut(low)
    two64, two63 = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (64, 63))
    return F.when(high >= two63, high - two64).otherwise(high).cast("bigint")


def sum_of_absolute_difference(x: Column, y: Column, z: Column) -> Column:
    return F.abs(_long(x) - _long(y)) + z


def shift_and_add(x: Column, n: int, y: Column, w: int = 32) -> Column:
    return mask(shift_left(x, n, w) + y, w)


def add3(x: Column, y: Column, z: Column, w: int = 32) -> Column:
    return mask(_long(x) + y + z, w)


def select_bytes(x: Column, y: Column, selector: int) -> Column:
    """Four bytes of the eight in (y, x), one a nibble of the selector; x gives bytes 0 to 3."""
    both, out = mask(x, 32).bitwiseOR(shift_left(y, 32)), F.lit(0).cast("bigint")
    for k in range(4):
        out = out.bitwiseOR(shift_left(bit_subsequence(both, 8 * (selector >> (4 * k) & 7), 8), 8 * k))
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C (reflected polynomial 0x82F63B78) of a BINARY column, as BIGINT: Spark's own crc32 has another polynomial.

    An Arrow-batched function: a byte table made from the polynomial, and all values of a batch a byte at a time.
    """

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
        there = values.notna().to_numpy()
        raw = [bytes(v) for v in values[there]]
        sizes = np.array([len(v) for v in raw], np.int64)
        # Longest first, so that those with a next byte are always the first ones.
        order = np.argsort(-sizes, kind="stable")
        flat, start = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(sizes) - sizes)[order]
        left, c = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left"), np.full(len(raw), 0xFFFFFFFF, np.uint32)
        for k, n in enumerate(left):
            c[:n] = c[:n] >> 8 ^ table[(c[:n] ^ flat[start[:n] + k]) & 255]
        got = np.empty(len(raw), np.int64)
        got[order] = c ^ np.uint32(0xFFFFFFFF)
        out = pd.Series(pd.NA, index=values.index, dtype="Int64")
        out[there] = got
        return out

    return run(data)
