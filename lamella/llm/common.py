"""Shared pieces of the training-data operators: scratch tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Without that setting a session in one process
    (master local) gets a temporary folder, and any other is an error: its executors couldn't read such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """A folder of intermediate tables under the shared one; tables are Parquet, so a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        give_back_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more: what was made of them is written itself."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


FEW, HOT_KEYS = 4096, 1 << 16


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, a written table of unique keys, each with n, its number of rows in left.

    Keys of more than FEW rows and more than one HOT_KEYS-th of all are at most HOT_KEYS, so these entries are broadcast
    and such keys' rows stay where they lie; all others meet in a shuffle. n is dropped.
    """
    rows = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(FEW, rows // HOT_KEYS)
    some, rest = right.where(hot).drop(n), right.where(~hot).drop(n)
    others = left.join(F.broadcast(some.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(some), keys).unionByName(others.join(rest, keys, how))


WORDS = 1 << 20


def likely_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is in right, a written table, and a small share of the others; nothing is shuffled for it.

    Keys of right mark 16 to 32 bits each of a bitmap, which is broadcast as words of 64 bits, WORDS of them at most; with
    more keys than that holds, more of the others stay.
    """
    words = min(WORDS, max(64, 1 << (right.count() * 16 // 64).bit_length()))
    word, bit = F.expr(f"shiftright(xxhash64(`{key}`), 6) & {words - 1}"), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
    marks = right.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return left.withColumn("_word", word).join(F.broadcast(marks), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row; maps count by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice's texts stay near max_bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable, schema: str, columns: list[str], text: str = "text", max_bytes: int = 8 << 20) -> DataFrame:
    """Runs fn(slice) -> dict of columns over bounded slices of the given columns. Schema is a DDL string."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for part in slices(batches, text, max_bytes):
            out = fn(part)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(*columns).mapInArrow(typed(run, schema), schema)


ARROW = {"array<bigint>": pa.list_(pa.int64()), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession) -> bool:
    """Hands freed memory of the driver back: that of its Python, and that outside the heap of its JVM, whose planning and
    compiling leave it in pieces. False where the JVM has no such command (HotSpot on glibc has it from 17.0.9 on)."""
    give_back()
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    named, new = jvm.java.lang.Class.forName, gateway.new_array
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class isn't exported, its interface is.
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def typed(fn: Callable, schema: str) -> Callable:
    """Casts what fn yields to the Arrow types of the DDL schema (empty and all-null columns come out untyped)."""
    want = [ARROW[x.split()[1]] for x in schema.split(",")]

    def run(batches):
        for b in fn(batches):
            yield pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(b.columns, want)], b.schema.names)
        give_back()

    return run


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id written as text, mod m; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(m))
