"""Values that larger tables bring: beyond the words and bounds that small tables keep to. Expected rows are the SQL's, by hand."""

import pytest
from pyspark.sql import functions as F

from lamella import queries
from lamella.functions import bits as B
from lamella.operators import layout
from lamella.types import I16, I32, I64

#: Beyond 2, 3, 4 and 7 bytes; below zero; at the ends of those stretches.
KEYS = {"u16": [0, 7, 65535], "u24": [3, 65536, (1 << 24) - 1], "u32": [5, 1 << 24, (1 << 32) - 1], "u56": [6, 1 << 32, (1 << 56) - 1], "all": [0, 65535, -5, 1 << 56, (1 << 63) - 1, -(1 << 63)]}


def orders(spark, path, keys):
    """A folder with orders of these customer keys, by order key from 0."""
    spark.createDataFrame(list(enumerate(keys)), "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["dzb_fixed_be", "dzb_fixed_le"])
@pytest.mark.parametrize("size", KEYS)
def test_null_suppression_holds_every_key(spark, tmp_path, name, size):
    out = queries.QUERIES[name](spark, orders(spark, tmp_path, KEYS[size]))
    assert dict(out.dtypes) == {"pos": "bigint", "value": "bigint"}
    assert sorted(map(tuple, out.collect())) == list(enumerate(KEYS[size]))


def test_null_suppression_keeps_two_bytes_where_they_do(spark, tmp_path):
    """Wider words are for larger keys only."""
    seen = []
    for size in KEYS:
        df = queries.custkeys(spark, orders(spark, tmp_path / size, KEYS[size]))
        queries.suppressed(df, queries.NARROW, lambda small, n, of, stored: seen.append((n, of.name, stored.name)) or small)
    assert seen == [(3, "u32", "u16"), (3, "u32", "u24"), (3, "u64", "u32"), (3, "u64", "u56"), (6, "u64", "u56")]


#: By segments of 1024: a distance beyond 2 bytes, only between segments, beyond 4, values beyond 4, distances beyond 8.
FRAMES = {
    "i16": [0, 32767, 5],
    "i32": [7, 32775, 40, 900000],
    "between": [*range(1024), *range(10**6, 10**6 + 1024)],
    "i64": [5, (1 << 31) + 5, 1 << 31, 6],
    "all": [-(1 << 63), (1 << 63) - 1, 5, 0, -1, *range(1100), 1 << 62],
}


@pytest.mark.parametrize("size", FRAMES)
def test_frames_hold_every_key(spark, tmp_path, size):
    out = queries.QUERIES["for_constant"](spark, orders(spark, tmp_path, FRAMES[size]))
    assert dict(out.dtypes) == {"pos": "bigint", "value": "bigint"}
    assert sorted(map(tuple, out.collect())) == list(enumerate(FRAMES[size]))


def test_frames_keep_two_bytes_where_they_do(spark, tmp_path):
    seen = []
    for size in FRAMES:
        df = queries.custkeys(spark, orders(spark, tmp_path / size, FRAMES[size]))
        queries.framed(df, 1024, [(I32, I16), (I32, I32), (I64, I64)], lambda small, n, of, stored: seen.append((n, of.name, stored.name)) or small)
    assert seen == [(3, "i32", "i16"), (4, "i32", "i32"), (2048, "i32", "i16"), (4, "i64", "i64"), (1106, "i64", "i64")]


def test_comparisons_of_large_keys(spark, tmp_path):
    """x + 20 y > 1999 is asked of keys that are beyond 1999 themselves."""
    keys = [0, 1958, 1959, 1999, 2000, 14999, 900000, (1 << 63) - 2000]
    out = queries.QUERIES["functor_cmp"](spark, orders(spark, tmp_path, keys)).orderBy("k").collect()
    assert [r.c_over for r in out] == [int(x + 20 * (1 + k) > 1999) for k, x in enumerate(keys)]
    assert [(r.c_eq, r.c_gt, r.c_odd) for r in out] == [(int(x == k + 1), int(x > k + 1), x % 2) for k, x in enumerate(keys)]


def test_patch_items_are_numbered_once(spark):
    """Of a patch too large for a sample to hold, each item has the number of its place, and comes back at its position."""
    n = 200_000
    patch = spark.range(0, n, 1, 8).select((F.col("id") * 3).alias("pos"), (-F.col("id")).alias("value"))
    parts = layout.compress_indices(patch, 64)
    assert parts["data"].where(F.col("p") != -F.col("value")).count() == 0 and parts["data"].count() == n
    target = spark.range(3 * n).select(F.col("id").alias("pos"), F.lit(1).cast("bigint").alias("value"))
    out = layout.compressed_indices_scatter(target, parts["data"], parts["runs"], parts["offset_bytes"], chunk_bytes=512, anchors=parts["anchors"], period=64)
    want = F.when(F.col("pos") % 3 == 0, -F.col("pos") / 3).otherwise(1)
    assert (out.where(F.col("value") == want).count(), out.count()) == (3 * n, 3 * n)


def test_upper_halves_of_products_are_not_rounded(spark):
    """Low halves of all ones: their share of a unit is nearer to 1 than six decimal places tell."""
    high = (1 << 64) - 1
    pairs = [(high, 1), (high, high), ((1 << 63) + 1, (1 << 33) - 1), ((1 << 32) - 1, (1 << 32) + 1), (0xFFFFFFFF00000001, 0xFFFFFFFF), (1 << 32, (1 << 32) - 1), (0, high), (1, 0xFFFFFFFF)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(k, signed(x), signed(y)) for k, (x, y) in enumerate(pairs)], "k int, x long, y long")
    got = rows.select("k", B.multiply_high(F.col("x"), F.col("y"), 64).alias("w"), B.multiply_high(F.col("x"), F.col("y"), 32).alias("n")).orderBy("k").collect()
    low = 0xFFFFFFFF
    assert [(r.w, r.n) for r in got] == [(signed(x * y >> 64), (x & low) * (y & low) >> 32) for x, y in pairs]


def test_rotations_of_keys_beyond_the_word(spark, tmp_path):
    """The SQL shifts whole keys, so that bits beyond 16 come in from above; the function rotates words of 16 bits."""
    keys = [0, 1, 65535, 65536, 65537, 90001, 900000, (1 << 40) + 12345]
    out = queries.QUERIES["bit_rotate"](spark, orders(spark, tmp_path, keys)).orderBy("k").collect()
    assert [(r.r_left, r.r_right) for r in out] == [((x << 7 | x >> 9) & 65535, (x >> 5 | x << 11) & 65535) for x in keys]
    one = spark.range(1).select(B.rotate_left(F.lit(0x1ABCD), 4, 16), B.rotate_right(F.lit(0x1ABCD), 4, 16)).first()
    assert tuple(one) == (0xBCDA, 0xDABC)


def test_registry_holds_every_key(spark, tmp_path):
    """More keys than two bytes can name, far from each other in a segment, some beyond 4 bytes or below zero."""
    keys = [i * 7919 % 210_011 for i in range(70_000)] + [1 << 31, (1 << 32) - 1, 1 << 40, -5]
    d = orders(spark, tmp_path, keys)
    out = queries.QUERIES["registry_roundtrip"](spark, d)
    assert dict(out.dtypes) == {"scheme": "string", "pos": "bigint", "value": "bigint"}
    back = out.join(queries.custkeys(spark, d).withColumnRenamed("value", "want"), "pos").groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("places"), F.count_if(F.col("value") == F.col("want")).alias("right"))
    assert sorted(map(tuple, back.collect())) == [(s, 70_004, 70_004, 70_004) for s in ("dictionary", "dzb_fixed", "for", "rle", "rpe")]
