"""Encoded columns as folders: a Parquet table for each part, and the scalar parameters as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..encoded import EncodedColumn
from ..operators.scan import exclusive_prefix

#: Column by which a part is sorted, so that row-group statistics prune segments.
ORDER = ("seg", "pos", "container", "run", "chunk", "interval", "p", "code", "i")


def save(column: EncodedColumn, path: str, spark: SparkSession) -> None:
    for name, df in column.parts.items():
        key = next((c for c in ORDER if c in df.columns), None)
        (df.repartitionByRange(key).sortWithinPartitions(key) if key else df).write.mode("overwrite").parquet(f"{path}/{name}")
    head = {"scheme": column.scheme, "length": column.length, "params": column.params, "parts": sorted(column.parts)}
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/_head")


def load(path: str, spark: SparkSession) -> EncodedColumn:
    # The folder's name begins with an underscore, which a reader of the parent skips; read by its own path it is seen.
    head = json.loads(spark.read.text(f"{path}/_head").first()[0])
    return EncodedColumn(head["scheme"], head["length"], head["params"], {p: spark.read.parquet(f"{path}/{p}") for p in head["parts"]})


def column(df: DataFrame, pos: str, value) -> DataFrame:
    """(pos, value) of a table whose pos column runs from 0."""
    return df.select(F.col(pos).cast("bigint").alias("pos"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with pos: its rows numbered from 0 in the given order, by ranges, never in one task."""
    # The number is given, so that no stage merges partitions and both readers of the ranges see the same ones.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("seg", F.spark_partition_id().cast("bigint"))
    before = exclusive_prefix(ranged.groupBy("seg").agg(F.count(F.lit(1)).alias("total")))
    row = F.row_number().over(Window.partitionBy("seg").orderBy(*order)) - 1
    return ranged.withColumn("_row", row).join(before, "seg").withColumn("pos", (F.col("_row") + F.coalesce("before", F.lit(0))).cast("bigint")).drop("seg", "_row", "before")
