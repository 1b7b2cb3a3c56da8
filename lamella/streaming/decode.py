"""Segments decode alone, so a stream of new segments needs no state: each micro-batch is an encoded column of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..encoded import EncodedColumn


def decode_stream(stream: DataFrame, to_column: Callable[[DataFrame], EncodedColumn], decode: Callable[[EncodedColumn], DataFrame], path: str, checkpoint: str):
    """Writes the decoded (pos, value) rows of each micro-batch to path as Parquet, a folder a batch; returns the query.

    to_column makes the batch's rows an EncodedColumn with whole segments. A batch that runs again replaces its folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        decode(to_column(df)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
