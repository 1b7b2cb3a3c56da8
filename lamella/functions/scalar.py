"""Algebra of scalar functions: each takes and gives Columns, and higher-order ones take and give such functions.

Arithmetic is Spark's (an overflow is an error under ANSI mode); wrap a result with types.wrap for modular words.
Division and remainder of integers truncate towards zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Word

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Arithmetic
plus: Binary = lambda x, y: x + y
minus: Binary = lambda x, y: x - y
multiplies: Binary = lambda x, y: x * y
modulus: Binary = lambda x, y: x % y
minimum: Binary = lambda x, y: F.least(x, y)
maximum: Binary = lambda x, y: F.greatest(x, y)


def divides(x: Column, y: Column) -> Column:
    """Integer quotient, truncated."""
    return F.call_function("div", x, y)


next_ = lambda x: x + 1
previous = lambda x: x - 1
increment = pre_increment = post_increment = next_
decrement = pre_decrement = post_decrement = previous
sign = lambda x: (x > 0).cast("int")  # noqa: E731  1 for positive values, else 0
negate = minus_unary = lambda x: -x
inverse = lambda x: divides(F.lit(1).cast("bigint"), x)  # noqa: E731  in the integers; inverse_real for reals
inverse_real = lambda x: F.lit(1.0) / x
absolute = lambda x: F.abs(x)
identity = lambda x: x


# Constants and casts
def cast(to: str) -> Unary:
    return lambda x: x.cast(to)


def constant(value) -> Callable[..., Column]:
    return lambda *x: F.lit(value)


zero = constant(0)


def constant_pair(a, b) -> Callable[..., Column]:
    return lambda *x: F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))


def constant_by_ratio(numerator, denominator) -> Callable[..., Column]:
    return lambda *x: F.lit(numerator / denominator)


# Affine
def affine_transform(a, b) -> Unary:
    return lambda x: _c(a) * x + _c(b)


def linear_transform(a) -> Unary:
    return lambda x: _c(a) * x


scale = linear_transform
twice = linear_transform(2)


def fixed_modulus(m) -> Unary:
    return lambda x: x % _c(m)


# Higher order
def curry_left(f: Binary, a) -> Unary:
    return lambda y: f(_c(a), y)


def curry_right(f: Binary, b) -> Unary:
    return lambda x: f(x, _c(b))


def compose(*fs: Unary) -> Unary:
    """compose(f, g)(x) is f(g(x))."""
    return lambda x: reduce(lambda v, f: f(v), reversed(fs), x)


def compose_on_binary(f: Unary, g: Binary) -> Binary:
    return lambda x, y: f(g(x, y))


def accumulate_from_rhs(f: Binary, g: Unary) -> Binary:
    """x, y to f(x, g(y)): g is applied to what is accumulated."""
    return lambda x, y: f(x, g(y))


# Ranges
strictly_between = lambda x, lo, hi: (x > _c(lo)) & (x < _c(hi))
between_or_equal = lambda x, lo, hi: (x >= _c(lo)) & (x <= _c(hi))
in_pair = lambda x, pair: (x >= pair["first"]) & (x <= pair["second"])
strictly_in_pair = lambda x, pair: (x > pair["first"]) & (x < pair["second"])


def within(lo, hi) -> Unary:
    return lambda x: between_or_equal(x, lo, hi)


def strictly_within(lo, hi) -> Unary:
    return lambda x: strictly_between(x, lo, hi)


# Comparison and predicates
equals: Binary = lambda x, y: x == y
not_equals: Binary = lambda x, y: x != y
greater: Binary = lambda x, y: x > y
less: Binary = lambda x, y: x < y
greater_equal: Binary = lambda x, y: x >= y
less_equal: Binary = lambda x, y: x <= y
is_zero = lambda x: x == 0
non_zero = lambda x: x != 0
is_non_negative = lambda x: x >= 0
is_positive = lambda x: x > 0
even = lambda x: x % 2 == 0
odd = lambda x: x % 2 != 0


def about_zero(digits: int) -> Unary:
    """|x| < 2^-digits"""
    return lambda x: F.abs(x) < F.lit(2.0**-digits)


# Logic, on numbers as truth values
_t = lambda x: x != 0
logical_and: Binary = lambda x, y: _t(x) & _t(y)
logical_or: Binary = lambda x, y: _t(x) | _t(y)
logical_not = lambda x: ~_t(x)
logical_xor: Binary = lambda x, y: _t(x) != _t(y)

# Ternary
clip = lambda x, lo, hi: F.least(F.greatest(x, _c(lo)), _c(hi))
if_then_else = lambda p, x, y: F.when(p, x).otherwise(y)
fused_multiply_add = lambda x, y, z: x * y + z


# Enumerated functions take (position, value).
def enumerated(f: Unary) -> Callable[[Column, Column], Column]:
    """A function of the value alone, as one of position and value."""
    return lambda pos, x: f(x)


# Host arithmetic
div_rounding_up = lambda x, y: divides(x + y - 1, y)
round_down = lambda x, y: x - F.pmod(x, y)
round_up = lambda x, y: x + F.pmod(-x, y)
ilog2 = lambda x: F.length(F.bin(x)) - 1
gcd_steps = 92  # Fibonacci numbers of 63 bits: no pair takes more steps of Euclid's algorithm


def gcd(x: Column, y: Column) -> Column:
    """Greatest common divisor of BIGINTs, by Euclid's steps in one fold."""
    start = F.struct(F.abs(x).cast("bigint").alias("a"), F.abs(y).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(gcd_steps)), start, step, lambda s: s.a)


def lcm(x: Column, y: Column) -> Column:
    g = gcd(x, y)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(divides(x, F.when(g == 0, F.lit(1)).otherwise(g)) * y))


def ipow(x: Column, n: int) -> Column:
    """Integer power by squaring."""
    out, base = F.lit(1).cast("bigint"), x.cast("bigint")
    while n:
        if n & 1:
            out = out * base
        n >>= 1
        base = base * base if n else base
    return out


def binomial(n: Column, k: Column) -> Column:
    """n over k; an overflow of BIGINT is an error."""
    k = F.least(k, n - k).cast("bigint")
    rows = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(rows, F.lit(1).cast("bigint"), lambda acc, i: divides(acc * (n.cast("bigint") - k + i), i)))


def exact_sum(values: Column) -> Column:
    """Sum of an array of doubles with running compensation of rounding errors."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a, x):
        y = x - a.c
        t = a.s + y
        return F.struct(t.alias("s"), ((t - a.s) - y).alias("c"))

    return F.aggregate(values, start, step, lambda a: a.s)


addition_overflows = lambda x, y: F.try_add(x, y).isNull() & x.isNotNull() & y.isNotNull()
subtraction_overflows = lambda x, y: F.try_subtract(x, y).isNull() & x.isNotNull() & y.isNotNull()
multiplication_overflows = lambda x, y: F.try_multiply(x, y).isNull() & x.isNotNull() & y.isNotNull()


def neutral(op: str, of: Word | None = None):
    """The value that an operation leaves unchanged: what an empty segment reduces to."""
    fixed = {"sum": 0, "minus": 0, "product": 1, "divides": 1, "bit_or": 0, "bit_xor": 0, "bit_and": -1, "logical_and": True, "logical_or": False}
    if op in fixed:
        return fixed[op]
    of = of or Word(8, True)
    return {"min": of.high, "max": of.low}[op]
