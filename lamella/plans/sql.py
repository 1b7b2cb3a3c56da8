"""SQL surface: encoded columns as views of a session, decoded by their registry entry when a query reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..encoded import EncodedColumn
from ..sources.store import load
from .registry import REGISTRY, Registry


def as_view(name: str, key: str, column: EncodedColumn, registry: Registry = REGISTRY, **more) -> DataFrame:
    """Makes name a temporary view (pos, value) of the column; filters on it are planned with the decoding."""
    df = registry[key].decode(column, **more)
    df.createOrReplaceTempView(name)
    return df


def stored_view(spark: SparkSession, name: str, key: str, path: str, registry: Registry = REGISTRY, **more) -> DataFrame:
    """as_view of a column that sources.store.save wrote to path."""
    return as_view(name, key, load(path, spark), registry, **more)
