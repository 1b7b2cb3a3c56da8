"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's rows form blocks. With integer weights w (sum W), time runs in frames of W slots in which a source gets w
blocks: the j-th of a frame is released at floor(j*W/w) and due at ceil((j+1)*W/w), and each slot goes to the released
block that is due first. Every block then stays within its window, so a source is always within one block of its
share. One frame's pattern serves all frames; the slots of a source that has run out are left out, which hands its
share to the others in proportion to their weights. No row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_hash

BLOCK_ROWS = 64
PART = 256
SPAN = 16384
CHUNK = 4096


def weight_of(weights: dict[str, int], default: int) -> Column:
    if any(int(w) != w or w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights are positive integers")
    if not weights:
        return F.lit(default).cast("long")
    out = F
    for k, w in weights.items():
        out = out.when(F.col("source") == k, F.lit(w))
    return out.otherwise(F.lit(default)).cast("long")


def frame_pattern(work: Scratch, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, w, rows) to members (i, source, w, rows, total) and a frame's slots (i, j, slot): the source's j-th slot.

    Earliest deadline first over one frame, as a fold over its slots. Sources of equal weight have equal windows, so
    they take turns in their order i: the fold keeps one counter a weight, and a slot costs as many steps as there are
    weights, however many sources. Picks are gathered in parts of PART slots.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source", "w", "rows"))).alias("s"), F.sum("w").alias("total"))
    members = work.table("members", one.select("total", F.posexplode("s").alias("i", "x")).select("i", "x.source", "x.w", "x.rows", "total"))
    classes = members.groupBy("w").agg(F.array_sort(F.collect_list("i")).alias("m"), F.max("total").alias("total"))
    row = classes.agg(F.array_sort(F.collect_list(F.struct("w", "m", F.size("m").cast("long").alias("n")))).alias("c"), F.max("total").alias("total"))
    fold = F.expr(f"""
        aggregate(sequence(0L, (total - 1) div {PART}),
          named_struct('done', array_repeat(0L, size(c)), 'out', cast(array() as array<array<int>>)),
          (acc, q) -> aggregate(
            array(aggregate(sequence(q * {PART}, least(total, (q + 1) * {PART}) - 1),
              named_struct('done', acc.done, 'out', cast(array() as array<int>)),
              (part, t) -> aggregate(
                array(array_min(filter(transform(c, (x, k) -> named_struct(
                    'due', ((part.done[k] div x.n + 1) * total + x.w - 1) div x.w,
                    'i', x.m[cast(part.done[k] % x.n as int)],
                    'k', k,
                    'ready', part.done[k] < x.w * x.n and ((part.done[k] div x.n) * total) div x.w <= t)), y -> y.ready))),
                part, (p, pick) -> named_struct(
                  'done', transform(p.done, (d, k) -> if(k = pick.k, d + 1, d)),
                  'out', array_append(p.out, pick.i))))),
            acc, (all, part) -> named_struct('done', part.done, 'out', array_append(all.out, part.out))),
          acc -> acc.out)""")
    parts = row.select(F.posexplode(fold).alias("q", "part"))
    picks = parts.select("q", F.posexplode("part").alias("p", "i")).select("i", (F.col("q").cast("long") * PART + F.col("p")).alias("slot"))
    slots = picks.select("i", (F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1).cast("long").alias("j"), "slot")
    return members, work.table("slots", slots)


def mix(df: DataFrame, weights: dict[str, int], default: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of df (doc_id, source, ...) with their place: block (number in the source), slot, mix_position from 0.

    Within a source the order is the MD5 of doc_id's digits, so blocks are mixed evenly; ties go to doc_id, then to a hash of the
    whole row, then arbitrarily among equal rows. A null source is a source of its own. weights: positive integers by source,
    default for the rest. Any number of sources and any weights; one frame's slots are found in one task, in time
    that grows with the sum of weights times the number of different ones. An empty table gives an empty one.

    A source may hold any share of the rows: it is ranked in buckets of the hash, whose counts give the offsets, so no
    task holds a source. Only counts by bucket and by source are gathered.
    """
    spark = df.sparkSession
    work = Scratch(spark, "mix")
    keyed = df.select("doc_id", "source", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"), row_hash(df).alias("_t"))
    keyed = work.table("keys", keyed)
    total = keyed.count()
    buckets = 1 << max(6, (total // 4_000).bit_length())
    bucket = F.expr(f"cast(conv(substr(_h, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    counts = work.table("counts", keyed.groupBy("source", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")))
    sources = counts.groupBy("source").agg(F.sum("n").alias("rows")).withColumn("w", weight_of(weights, default))
    members, slots = frame_pattern(work, sources)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("source", "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    per = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "_t")
    ranked = keyed.withColumn("_b", bucket).withColumn("_rn", F.row_number().over(per) - 1)
    ranked = ranked.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._b") == F.col("s._b"))).select("r.doc_id", "r.source", "r._t", (F.col("s._start") + F.col("r._rn")).alias("_rank"))
    # Blocks: (source, block, rows in it, slot of virtual time), then their offsets in the mixed order.
    # Chunks of CHUNK blocks are dealt out before they are listed, so a large source's blocks are many tasks' work.
    last = F.expr(f"(rows - 1) div {block_rows}")
    chunks = members.withColumn("last", last).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {CHUNK}")))).repartition("i", "c")
    blocks = chunks.withColumn("block", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("last"), F.col("c") * CHUNK + (CHUNK - 1))))).withColumn("j", F.expr("block % w"))
    blocks = blocks.join(slots.withColumnRenamed("slot", "_slot"), ["i", "j"]).select(
        "source", "block", F.least(F.lit(block_rows).cast("long"), F.col("rows") - F.col("block") * block_rows).alias("n"),
        (F.expr("block div w") * F.col("total") + F.col("_slot")).alias("slot"), "total",
    )
    frames = F.expr(f"slot div least(total, {SPAN})")
    blocks = work.table("blocks", blocks.withColumn("_f", frames))
    by_frame = work.table("frames", blocks.groupBy("_f").agg(F.sum("n").alias("n")))
    # Offsets of frames (of SPAN slots of longer ones) in two levels: runs of 4096 frames, then frames in a run.
    runs = by_frame.groupBy(F.expr("_f div 4096").alias("_r")).agg(F.sum("n").alias("n"))
    runs = runs.select("_r", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_run_start"))
    in_run = Window.partitionBy("_r").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_frame.withColumn("_r", F.expr("_f div 4096")).withColumn("_in", F.coalesce(F.sum("n").over(in_run), F.lit(0))).join(runs, "_r").select("_f", (F.col("_run_start") + F.col("_in")).alias("_frame_start"))
    in_frame = Window.partitionBy("_f").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_in", F.coalesce(F.sum("n").over(in_frame), F.lit(0))).join(offsets, "_f").select("source", "block", "slot", (F.col("_frame_start") + F.col("_in")).alias("_at"))
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block_rows}"))
    out = ranked.alias("r").join(placed.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.block") == F.col("p.block")))
    return out.select("r.doc_id", "r.source", "r._t", "r.block", "p.slot", (F.col("p._at") + F.expr(f"r._rank % {block_rows}")).alias("mix_position"))


def in_mixed_order(df: DataFrame, weights: dict[str, int], default: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of df, all columns and mix_position (replaced if there), as files in its order: ranges of it, each sorted.

    Rows meet their positions by doc_id and a hash of the whole row. Of equal rows one is kept and joined with all their
    positions, a row each, so a group of equal rows is never gathered in an array.
    """
    names = [c for c in df.columns if c.lower() != "mix_position"]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    place = mix(df, weights, default, block_rows).select(F.xxhash64("doc_id").alias("k"), F.col("_t").alias("t"), "mix_position")
    here = df.select(F.xxhash64("doc_id").alias("k"), row_hash(df).alias("t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    # Counted in the order of the merge join, whose exchange and sort this shares.
    by = Window.partitionBy("k", "t").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = here.withColumn("n", F.count(F.lit(1)).over(by)).where("n = 1").drop("n")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = one.join(place.hint("merge"), ["k", "t"]).select("row.*", "mix_position")
    return out.repartitionByRange(n, "mix_position").sortWithinPartitions("mix_position")
