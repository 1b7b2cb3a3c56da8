"""Hand-computed fixtures, round trips at boundary lengths, and errors."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lamella.encoded import EncodedColumn
from lamella.functions import models
from lamella.functions.scalar import neutral
from lamella.operators import layout, scan
from lamella.operators.schemes import bitmaps, delta, dictionary, dzb_fixed, dzb_variable, frame_of_reference, model, rle, rpe
from lamella.plans.registry import REGISTRY, Registry, SchemeSpec, UnknownScheme
from lamella.sources.store import load, save
from lamella.types import I16, I32, U8, U16, U32, U64, EncodingError, Word, bytes_to_fit, nearly_equal, word_to_fit


def df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def values(out):
    rows = sorted((r["pos"], r["value"]) for r in out.collect())
    assert [p for p, _ in rows] == list(range(len(rows)))
    return [int(v) if not isinstance(v, (str, type(None))) else v for _, v in rows]


def column(spark, xs, kind="bigint"):
    return df(spark, f"pos long, value {kind}", list(enumerate(xs)))


def test_delta(spark):
    parts = {"compressed_input": df(spark, "pos long, delta int", list(enumerate([1, 2, 3, 4, 5, 6]))), "anchor_values": df(spark, "seg long, anchor int", [(0, 10), (1, 20)])}
    assert values(delta.decode(EncodedColumn("delta", 6, {"segment_length": 4, "word": "u16"}, parts))) == [11, 13, 16, 20, 25, 31]
    parts = {"compressed_input": df(spark, "pos long, delta int", [(0, 1), (1, 1)]), "anchor_values": df(spark, "seg long, anchor int", [(0, 65535)])}
    assert values(delta.decode(EncodedColumn("delta", 2, {"segment_length": 4, "word": "u16"}, parts))) == [0, 1]


def test_dictionary(spark):
    parts = {"compressed_input": df(spark, "pos long, code int", [(0, 2), (1, 0), (2, 2)]), "dictionary_entries": df(spark, "code int, value string", [(0, "a"), (1, "b"), (2, "c")])}
    assert values(dictionary.decode(EncodedColumn("dictionary", 3, {}, parts))) == ["c", "a", "c"]


def test_dzb_fixed(spark):
    assert values(dzb_fixed.decode(EncodedColumn("dzb_fixed", 2, {"word": "u32", "stored": "u16"}, {"compressed_input": df(spark, "pos long, v int", [(0, 0xFFFF), (1, 1)])}))) == [65535, 1]
    d = df(spark, "v binary", [(bytes.fromhex("ABCD"),)])
    assert d.select(dzb_fixed.padded(d.v, 4, "big").alias("x"), dzb_fixed.padded(d.v, 4).alias("y")).first() == (bytes.fromhex("0000ABCD"), bytes.fromhex("ABCD0000"))
    for order in ("little", "big"):
        assert values(dzb_fixed.decode(dzb_fixed.encode(column(spark, [0, 1, 258, 65535]), 4, U32, U16, order, binary=True))) == [0, 1, 258, 65535]


def test_dzb_variable(spark):
    parts = {"compressed_data": df(spark, "seg long, bytes binary", [(0, bytes.fromhex("050102FF"))]), "packed_element_sizes": df(spark, "container long, word long", [(0, 4)]), "position_anchors": df(spark, "seg long, byte_offset long", [(0, 0)])}
    assert values(dzb_variable.decode(EncodedColumn("dzb_variable", 3, {"segment_length": 32, "word": "u32", "min_represented_element_size": 1, "bits_per_element_size": 2}, parts))) == [5, 513, 255]


def test_frame_of_reference(spark):
    parts = {"compressed_input": df(spark, "pos long, offset int", list(enumerate([0, -1, 1, 0, 5, -5]))), "segment_model_coefficients": df(spark, "seg long, c0 int, c1 int", [(0, 10, 3), (1, 100, 0)])}
    c = EncodedColumn("frame_of_reference", 6, {"segment_length": 4, "word": "i32", "model": "linear"}, parts)
    assert values(frame_of_reference.decode(c)) == [10, 12, 17, 19, 105, 95]
    for n in (0, 6):
        c.params["segment_length"] = n
        with pytest.raises(EncodingError):
            frame_of_reference.decode(c)


def test_bitmaps(spark):
    parts = {"incidence_bitmaps": df(spark, "bitmap int, container long, bits int", [(0, 0, 0b0101), (1, 0, 0b1010)]), "dictionary_entries": df(spark, "code int, value string", [(0, "x"), (1, "y")])}
    assert values(bitmaps.decode(EncodedColumn("bitmaps", 4, {}, parts))) == ["x", "y", "x", "y"]
    assert values(bitmaps.decode(EncodedColumn("bitmaps", 5, {}, parts), on_gap="null")) == ["x", "y", "x", "y", None]
    with pytest.raises(Exception, match="none has position"):
        bitmaps.decode(EncodedColumn("bitmaps", 5, {}, parts)).collect()
    flat = df(spark, "index long, bits int", [(0, 5), (1, 9), (2, 10)])
    assert sorted(map(tuple, bitmaps.from_flat(flat, 1).collect())) == [(0, 0, 5), (1, 0, 10)]


def test_models(spark):
    assert values(model.decode(EncodedColumn("model", 3, {"model": "linear", "model_coefficients": [7, 2], "word": "i32"}), spark=spark)) == [7, 9, 11]
    assert values(model.decode(EncodedColumn("model", 3, {"model": "polynomial", "model_coefficients": [2, 3], "word": "i32"}), spark=spark))[2] == 17
    with pytest.raises(EncodingError):
        models.evaluate("linear", [], None)


def test_runs(spark):
    runs = df(spark, "run long, value int, length int", [(0, 7, 3), (1, 8, 4)])
    anchors = df(spark, "seg long, run long, intra_run_offset int", [(0, 0, 0), (1, 1, 1)])
    want = [7, 7, 7, 8, 8, 8, 8]
    assert values(rle.decode(EncodedColumn("rle", 7, {"segment_length": 4}, {"runs": runs, "anchors": anchors}))) == want
    assert values(rle.decode(EncodedColumn("rle", 7, {"segment_length": 4}, {"runs": runs}))) == want
    starts = df(spark, "run long, value int, start int", [(0, 7, 0), (1, 8, 3)])
    at = df(spark, "seg long, run long", [(0, 0), (1, 1)])
    for relative in (False, True):
        assert values(rpe.decode(EncodedColumn("rpe", 7, {"segment_length": 4, "relative": relative}, {"runs": starts, "anchors": at}))) == want
    aligned = df(spark, "run long, value int, start int", [(0, 7, 0), (1, 8, 0)])
    assert values(rpe.decode(EncodedColumn("rpe", 6, {"segment_length": 4, "relative": True}, {"runs": aligned, "anchors": at}))) == [7, 7, 7, 7, 8, 8]


def test_patches(spark):
    target = column(spark, [0] * 5)
    assert values(layout.scatter(target, df(spark, "pos long, value long", [(1, 9), (3, 8)]))) == [0, 9, 0, 8, 0]
    with pytest.raises(Exception, match="several values"):
        layout.scatter(target, df(spark, "pos long, value long", [(1, 9), (1, 8)])).collect()
    runs = df(spark, "run long, length long, offset_bits int, baseline long, offsets_start long", [(0, 2, 8, 100, 0), (1, 1, 16, 500, 1)])
    data = bytes([0, 4, 0, 0]) + (300).to_bytes(2, "little")
    got = layout.compressed_positions(runs, df(spark, "chunk long, bytes binary", [(0, data)]))
    assert sorted(map(tuple, got.collect())) == [(0, 100), (1, 104), (2, 800)]
    with pytest.raises(EncodingError):
        layout.resolve_compressed_scatter(0, 4)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 101])
def test_round_trips(spark, n):
    r = random.Random(n)
    xs = [r.choice([r.randrange(4), r.randrange(1 << 16), 7]) for _ in range(n)]
    up = sorted(xs)
    runs = [x // 20000 for x in up]
    assert values(delta.decode(delta.encode(column(spark, up), n, 32, U64, U32))) == up
    assert values(dictionary.decode(dictionary.encode(column(spark, xs), n, U16))) == xs
    assert values(dzb_fixed.decode(dzb_fixed.encode(column(spark, xs), n, U32, U16))) == xs
    assert values(dzb_variable.decode(dzb_variable.encode(column(spark, xs), n, 32, U32))) == xs
    for kind in ("constant", "linear"):
        assert values(frame_of_reference.decode(frame_of_reference.encode(column(spark, xs), n, 32, I32, I32, kind))) == xs
    assert values(rle.decode(rle.encode(column(spark, runs), n, 32, U8))) == runs
    for relative in (False, True):
        assert values(rpe.decode(rpe.encode(column(spark, runs), n, 32, U16, relative))) == runs
    assert values(bitmaps.decode(bitmaps.encode(column(spark, runs), n))) == runs
    if n > 50:
        for m, c in ((delta, delta.encode(column(spark, up), n, 32, U64, U32)), (rle, rle.encode(column(spark, runs), n, 32, U8))):
            got = sorted((x.pos, int(x.value)) for x in m.decode(c, 20, 50).collect())
            assert got == [(i, (up if m is delta else runs)[i]) for i in range(20, 50)]


def test_scans(spark):
    xs = [3, -1, 4, 1, -5, 9, 2, 6]
    c = column(spark, xs)
    assert values(scan.two_phase_scan(c, 3)) == [3, 2, 6, 7, 2, 11, 13, 19]
    assert values(scan.two_phase_scan(c, 3, inclusive=False)) == [0, 3, 2, 6, 7, 2, 11, 13]
    assert values(scan.two_phase_scan(c, 3, "max")) == [3, 3, 4, 4, 4, 9, 9, 9]
    assert values(scan.two_phase_scan(c, 3, "min")) == [3, -1, -1, -1, -5, -5, -5, -5]
    got = scan.segmented_reduce(c, 3, "min", segments=4).orderBy("seg").collect()
    assert [r.value for r in got] == [-1, -5, 2, (1 << 63) - 1]
    assert values(scan.two_phase_scan(column(spark, [200, 100]), 1, of=Word(1))) == [200, 44]


def test_registry(spark, tmp_path):
    assert len(REGISTRY) == 163 and "delta/u32/u8/index4" in REGISTRY
    with pytest.raises(UnknownScheme):
        REGISTRY["none"]
    own = Registry()
    spec = SchemeSpec("k", None, {})
    own.add(spec)
    own.add(spec)
    with pytest.raises(EncodingError):
        own.add(spec, ignore_repeats=False)
    c = frame_of_reference.encode(column(spark, [5, 6, 7]), 3, 4, I32, I16)
    save(c, str(tmp_path / "c"), spark)
    back = load(str(tmp_path / "c"), spark)
    assert values(REGISTRY["frame_of_reference/constant4/i32/i16/index4"].decode(back)) == [5, 6, 7]
    del back.parts["compressed_input"]
    with pytest.raises(EncodingError):
        REGISTRY["frame_of_reference/constant4/i32/i16/index4"].decode(back)
    with pytest.raises(EncodingError):
        dzb_fixed.encode(column(spark, [1]), 1, U16, U16)
    assert word_to_fit(0, 256) == U16 and word_to_fit(-1, 3).name == "i8"


def test_example(spark):
    from lamella.queries import example_column

    assert values(frame_of_reference.decode(example_column(spark))) == [100 * (i // 2048) + i % 2048 for i in range(8192)]


def test_ranges_read_only_their_runs(spark, tmp_path):
    """The scan of runs has both bounds pushed down."""
    xs = [i // 7 % 50 for i in range(2000)]
    for name, module, made in (("rle", rle, rle.encode(column(spark, xs), 2000, 64, U16)), ("rpe", rpe, rpe.encode(column(spark, xs), 2000, 64, U16, True)), ("rpa", rpe, rpe.encode(column(spark, xs), 2000, 64, U32))):
        save(made, str(tmp_path / name), spark)
        back = load(str(tmp_path / name), spark)
        for lo, hi in ((0, 1), (100, 150), (640, 704), (1990, 2000), (63, 65), (5, 5)):
            out = module.decode(back, lo, hi)
            assert sorted((x.pos, x.value) for x in out.collect()) == [(i, xs[i]) for i in range(lo, hi)], (name, lo, hi)
        plan = module.decode(back, 640, 700)._jdf.queryExecution().toString()
        scans = [x for x in plan.split("\n") if "FileScan parquet [run#" in x]
        assert scans and all("GreaterThanOrEqual(run," in x and "LessThanOrEqual(run," in x for x in scans), scans


def test_byte_stream(spark):
    r = random.Random(3)
    xs = [r.choice([0, 1, 300, 70000, (1 << 32) - 1]) for _ in range(500)]
    for size in (1, 7, 64, 10_000):
        c = dzb_variable.encode(column(spark, xs), 500, 32, U32, stream_bytes=size)
        assert values(dzb_variable.decode(c)) == xs
        assert sorted((x.pos, int(x.value)) for x in dzb_variable.decode(c, 100, 170).collect()) == [(i, xs[i]) for i in range(100, 170)]
    zero = dzb_variable.encode(column(spark, [0] * 40), 40, 32, U32, least=0, stream_bytes=8)
    assert values(dzb_variable.decode(zero)) == [0] * 40
    raw = bytes.fromhex("050102FFFFFF")
    parts = {"compressed_data": df(spark, "chunk long, bytes binary", [(0, raw[:4]), (1, raw[4:])]), "packed_element_sizes": df(spark, "container long, word long", [(0, 0b10_00_01_00)]), "position_anchors": df(spark, "seg long, byte_offset long", [(0, 0), (1, 3)])}
    c = EncodedColumn("dzb_variable", 4, {"segment_length": 2, "word": "u32", "min_represented_element_size": 1, "bits_per_element_size": 2, "stream_bytes": 4}, parts)
    with pytest.raises(EncodingError):
        dzb_variable.decode(EncodedColumn("dzb_variable", 4, c.params, {k: v for k, v in parts.items() if k != "position_anchors"}))
    parts["packed_element_sizes"] = df(spark, "container long, word long", [(0, 0b01_00_01_00)])
    assert values(dzb_variable.decode(EncodedColumn("dzb_variable", 4, c.params, parts))) == [5, 0x0201, 255, 0xFFFF]


def test_products_wrap(spark):
    got = scan.segmented_reduce(column(spark, [10] * 64), 64, "product", of=U32).first()["value"]
    assert int(got) == 10**64 % (1 << 32)
    xs = [(1 << 63) + 12345, 3, (1 << 64) - 1, 7, 11, (1 << 40) + 1]
    for of in (U64, Word(8, True), U16, Word(2, True)):
        want, acc, own = [], 1, [x % (1 << of.bits) for x in xs]
        for x in own:
            acc = acc * x % (1 << of.bits)
            want.append(acc - (1 << of.bits) if of.signed and acc >> (of.bits - 1) else acc)
        assert values(scan.two_phase_scan(column(spark, list(map(Decimal, own)), "decimal(20,0)"), 4, "product", of=of)) == want
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
        scan.segmented_reduce(column(spark, [10**9] * 9), 64, "product").collect()


def test_dictionary_of_many_entries(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "FEW", 10)
    xs = [(i * 7) % 40 for i in range(100)]
    c = dictionary.encode(column(spark, xs), 100, U8, U32)
    assert values(dictionary.decode(c)) == xs
    assert [tuple(x) for x in c.parts["dictionary_entries"].orderBy("code").collect()] == list(enumerate(sorted(set(xs))))
    REGISTRY["dictionary/u32/u8/index4"].check(c)
    with pytest.raises(EncodingError):
        REGISTRY["dictionary/u64/u8/index4"].check(c)


def test_crc32c(spark):
    def plain(v):
        c = 0xFFFFFFFF
        for b in v:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    from lamella.functions.bits import crc32c

    rows = [b"123456789", b"", None, bytes(range(256)) * 3, b"a", b"123456789"]
    got = df(spark, "k int, v binary", list(enumerate(rows))).select("k", crc32c(F.col("v")).alias("c")).collect()
    assert {x.k: x.c for x in got} == {k: None if v is None else plain(v) for k, v in enumerate(rows)} and plain(rows[0]) == 0xE3069283


def test_neutral_values_and_words(spark):
    plain = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b, "min": min, "max": max, "bit_and": lambda a, b: a & b, "bit_or": lambda a, b: a | b, "bit_xor": lambda a, b: a ^ b, "logical_and": lambda a, b: a and b, "logical_or": lambda a, b: a or b}
    for op, f in plain.items():
        of = Word(1, True)
        for x in (True, False) if op.startswith("logical") else (-128, -1, 0, 5, 127):
            assert f(neutral(op, of), x) == x == f(x, neutral(op, of)), op
            kind = "boolean" if op.startswith("logical") else "bigint"
            got = scan.segmented_reduce(column(spark, [x], kind), 1, op, of=of, segments=2).orderBy("seg").collect() if x in (5, True) else None
            assert got is None or [int(r.value) for r in got] == [int(x), int(neutral(op, of))]
    for lo, hi, name in ((0, 255, "u8"), (0, 256, "u16"), (-128, 127, "i8"), (-129, 0, "i16"), (0, 1 << 32, "u64"), (-1, 1 << 31, "i64")):
        assert word_to_fit(lo, hi).name == name
    with pytest.raises(EncodingError):
        word_to_fit(-1, 1 << 63)
    assert [bytes_to_fit(x) for x in (0, 255, 256, 65536, 1 << 24, 1 << 56)] == [1, 1, 2, 3, 4, 8]
    got = spark.range(1).select(nearly_equal(F.lit(1.0), F.lit(1 + 1e-7)), nearly_equal(F.lit(1.0), F.lit(1.1)), nearly_equal(F.lit(0.0), F.lit(0.0))).first()
    assert tuple(got) == (True, False, True)


def test_every_registry_key(spark):
    """Each of the 163 combinations decodes a small column of its own words; by scheme, in one job."""
    n, low = 40, [i // 4 for i in range(40)]
    base, found = column(spark, low), {}
    word = lambda name: Word(int(name[1:]) // 8, name[0] == "i")
    patch = df(spark, "pos long, value long", [(3, 100), (17, 101)])
    squeezed = layout.compress_indices(patch, 8)
    wide = column(spark, [9] * n)

    def made(key):
        scheme, *rest = key.split("/")
        rest, size = rest[:-1], int(rest[-1].removeprefix("index"))
        if scheme == "delta":
            return delta.encode(base, n, 16, word(rest[0]), word(rest[1])), low
        if scheme == "dzb_fixed":
            return dzb_fixed.encode(base, n, word(rest[0]), word(rest[1])), low
        if scheme == "dictionary":
            return dictionary.encode(base, n, word(rest[1]), word(rest[0])), low
        if scheme == "dzb_variable":
            return dzb_variable.encode(base, n, 32, word(rest[0]), int(rest[1].removeprefix("container")), bits=2), low
        if scheme == "frame_of_reference":
            return frame_of_reference.encode(base, n, 16, word(rest[1]), word(rest[2]), rest[0][:-1]), low
        if scheme == "bitmaps":
            return (bitmaps.encode(base, n) if rest[-1] == "dictionary" else bitmaps.encode(base, n, U8)), low
        if scheme == "model":
            return EncodedColumn("model", n, {"model": rest[0], "model_coefficients": [5, 2][: 1 + (rest[0] == "linear")], "word": rest[1]}), [5 + 2 * i * (rest[0] == "linear") for i in range(n)]
        if scheme == "rle":
            return rle.encode(base, n, 16, word(rest[1])), low
        if scheme == "rpe":
            return rpe.encode(base, n, 16, word(rest[2]), rest[0] == "relative"), low
        want = [100 if i == 3 else 101 if i == 17 else 9 for i in range(n)]
        if scheme == "scatter":
            return EncodedColumn("scatter", n, {}, {"target": wide, "patch": patch}), want
        return EncodedColumn(scheme, n, {"anchoring_period": 8, "chunk_bytes": 64}, {"target": wide, **squeezed}), want

    more = {"model": {"spark": spark}}
    for key in REGISTRY:
        c, want = made(key)
        out = REGISTRY[key].decode(c, **more.get(key.split("/")[0], {})).select(F.lit(key).alias("key"), "pos", F.col("value").cast("bigint").alias("value"))
        found.setdefault(key.split("/")[0], []).append((key, out, want))
    assert sum(map(len, found.values())) == 163
    for some in found.values():
        for a in range(0, len(some), 8):
            both = some[a][1]
            for _, out, _ in some[a + 1 : a + 8]:
                both = both.unionByName(out)
            got = {}
            for x in both.collect():
                got.setdefault(x.key, []).append((x.pos, x.value))
            for key, _, want in some[a : a + 8]:
                assert sorted(got[key]) == list(enumerate(want)), key


def test_streaming_and_views(spark, tmp_path):
    """Micro-batches of whole segments decode to the plain column; a view decodes under SQL."""
    from lamella.plans.sql import stored_view
    from lamella.streaming.decode import decode_stream

    rows = df(spark, "seg long, run long, value int, length int", [(s, 3 * s + k, 10 * s + k, k + 1) for s in range(4) for k in range(3)])
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def to_column(batch):  # runs of a segment, each batch a column of its own
        runs = batch.select(F.col("run"), "value", "length")
        return EncodedColumn("rle", 1 << 20, {"segment_length": 6}, {"runs": runs})

    decode_stream(stream, to_column, rle.decode, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("value").count().collect()
    assert {x["value"]: x["count"] for x in got} == {10 * s + k: k + 1 for s in range(4) for k in range(3)}
    save(frame_of_reference.encode(column(spark, list(range(50, 90))), 40, 8, I32, I16), str(tmp_path / "c"), spark)
    stored_view(spark, "decoded", "frame_of_reference/constant4/i32/i16/index4", str(tmp_path / "c"))
    assert spark.sql("select sum(value) as s, count(*) as n from decoded where pos >= 30").first()[:] == (sum(range(80, 90)), 10)


def test_own_functions(spark):
    """User functions are Columns to Columns; a vectorised Python function is one too."""
    square = F.pandas_udf(lambda v: v * v, "bigint")
    assert values(scan.elementwise(column(spark, [1, 2, 3]), square)) == [1, 4, 9]
    assert values(scan.two_phase_scan(column(spark, [1, 2, 3]), 2, pre=lambda pos, v: square(v) + pos)) == [1, 6, 17]
