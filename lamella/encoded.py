"""Encoded columns: a scheme's name, scalar parameters and part tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .types import EncodingError


@dataclass
class EncodedColumn:
    """parts are DataFrames with explicit positions, so their row order means nothing. Values are non-null; a nullable
    column keeps its validity in a bit vector beside it (functions.bitvector)."""

    scheme: str
    length: int
    params: dict = field(default_factory=dict)
    parts: dict[str, DataFrame] = field(default_factory=dict)

    def part(self, name: str, *columns: str) -> DataFrame:
        if name not in self.parts:
            raise EncodingError(f"{self.scheme}: part {name!r} is missing")
        missing = [c for c in columns if c not in self.parts[name].columns]
        if missing:
            raise EncodingError(f"{self.scheme}: part {name!r} has no column {', '.join(missing)}")
        return self.parts[name]

    def param(self, name: str, default=None):
        if name not in self.params and default is None:
            raise EncodingError(f"{self.scheme}: parameter {name!r} is missing")
        return self.params.get(name, default)

    def segment_length(self) -> int:
        n = self.param("segment_length")
        if not isinstance(n, int) or n <= 0:
            raise EncodingError(f"{self.scheme}: segment_length must be a positive integer, not {n!r}")
        return n
