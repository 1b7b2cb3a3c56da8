"""Models of a column's values by position: coefficients to an expression of x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import EncodingError


def zero(c: list[Column], x: Column) -> Column:
    return F.lit(0).cast("bigint")


def constant(c: list[Column], x: Column) -> Column:
    return c[0]


def linear(c: list[Column], x: Column) -> Column:
    return c[0] + c[1] * x


def polynomial(c: list[Column], x: Column) -> Column:
    """1 + c0*x + c1*x^2 + ...: the form without a free constant term."""
    out = c[-1]
    for k in reversed(c[:-1]):
        out = k + out * x
    return F.lit(1) + out * x


def poly_standard(c: list[Column], x: Column) -> Column:
    """c0 + c1*x + c2*x^2 + ..."""
    out = c[-1]
    for k in reversed(c[:-1]):
        out = k + out * x
    return out


#: name -> (function, number of coefficients; 0 for one or more)
MODELS = {"zero": (zero, None), "constant": (constant, 1), "linear": (linear, 2), "polynomial": (polynomial, 0), "poly_standard": (poly_standard, 0)}


def evaluate(model: str, coefficients: list[Column], x: Column) -> Column:
    """Value at x, in BIGINT or, with float coefficients, DOUBLE truncated towards zero to BIGINT."""
    if model not in MODELS:
        raise EncodingError(f"no model {model!r}")
    fn, n = MODELS[model]
    if n is not None and (n and len(coefficients) != n or not n and not coefficients):
        raise EncodingError(f"model {model} takes {n or 'one or more'} coefficients, not {len(coefficients)}")
    return fn(coefficients, x).cast("bigint")


def literals(values: list) -> list[Column]:
    return [F.lit(v) if isinstance(v, float) else F.lit(int(v)).cast("bigint") for v in values]
