"""Line dedup: suffix ranks of line-ID sequences by prefix doubling, with DataFrame functions only.

Every text is a sequence of lines. Lines that stand once in the corpus can't be in a repeated run, so only stretches of
repeated lines are kept. Their suffixes are ranked by their first line, then by 2, 4, 8 ... lines: the pair (rank of
the first half, rank of the second half), sorted over the whole corpus, gives the rank at the doubled depth. Suffixes
that share their first m lines form one LCP interval, which the ranks of the two depth-2^k prefixes covering m lines
name. A run counts if its words reach min_words or, without min_words, if one of its lines has a letter or digit; from
each line, the shortest such run that starts there and the shortest that ends there are looked up. Those of one text
with one offset to their first copies, merged, are the maximal repeated runs, at whatever depth they reach.
Every copy but the first (by doc_id, then place) is deleted, but never a line inside that first copy itself: where a
run overlaps its first copy in one text, only what lies behind the first copy's end goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_counted

MIN_WORDS = 20
CONTENT = r"[\p{L}\p{N}]"


def words(line: Column) -> Column:
    """Words of a line, at least 1, so that every run of min_words lines is long enough."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda x: x != "")))


def global_ranks(work: Scratch, name: str, keys: DataFrame) -> DataFrame:
    """Distinct rows of keys (a, b) with their dense rank in sorted order, without gathering them in one task."""
    ranged = keys.distinct().repartitionByRange("a", "b").select("a", "b", F.spark_partition_id().alias("_p"))
    ranged = work.table(name, ranged)
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    starts = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_p").select("a", "b", (F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy("a", "b"))).alias("rank"))


def repeated_lines(work: Scratch, docs: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, th, pos, run, weight w, first line's ids a, b): lines that stand twice or more, in runs of neighbours."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Two independent 64-bit hashes and the length stand for the line.
    lines = lines.select("doc_id", "th", "pos", weight(F.col("line")).alias("w"), F.xxhash64("line").alias("a"), F.xxhash64(F.length("line"), F.reverse("line")).alias("b"))
    lines = work.table("lines", lines)
    often = work.table("often", lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = join_counted(lines, often, ["a", "b"])
    here = Window.partitionBy("doc_id", "th").orderBy("pos")
    return work.table("held", held.select("doc_id", "th", "pos", "w", "a", "b", (F.col("pos") - F.row_number().over(here)).alias("run")))


def spans_by_words(level: DataFrame, place: list[str], min_words: int) -> DataFrame:
    """(place, start, m): the shortest runs of min_words from each line on and up to each line."""
    by = Window.partitionBy(*place).orderBy("pos")
    # A run holds at least a word a line, so min_words lines are enough to look at.
    ahead = F.collect_list("w").over(by.rowsBetween(0, min_words - 1))
    back = F.collect_list("w").over(by.rowsBetween(-(min_words - 1), 0))
    total = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s")), lambda acc, x: F.when(acc.s >= min_words, acc).otherwise(F.struct((acc.n + 1).alias("n"), (acc.s + x).cast("int").alias("s"))))
    spans = level.withColumn("f", total(ahead)).withColumn("g", total(F.reverse(back)))
    return spans.select(*place, F.explode(F.array(
        F.struct(F.col("pos").alias("start"), F.col("f.n").alias("m"), F.col("f.s").alias("s")),
        F.struct((F.col("pos") - F.col("g.n") + 1).alias("start"), F.col("g.n").alias("m"), F.col("g.s").alias("s")),
    )).alias("x")).select(*place, "x.start", "x.m", "x.s").where(F.col("s") >= min_words).distinct()


def spans_by_content(level: DataFrame, place: list[str]) -> DataFrame:
    """(place, start, m): from each line, the run to the next line with content and the run from the last one, itself included."""
    own = F.when(F.col("w") > 0, F.col("pos"))
    by = Window.partitionBy(*place)
    spans = level.withColumn("f", F.min(own).over(by.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("g", F.max(own).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return spans.select(*place, F.explode(F.array(
        F.struct(F.col("pos").alias("start"), (F.col("f") - F.col("pos") + 1).alias("m")),
        F.struct(F.col("g").alias("start"), (F.col("pos") - F.col("g") + 1).alias("m")),
    )).alias("x")).select(*place, "x.start", "x.m").where("m is not null").distinct()


def repeated_runs(docs: DataFrame, min_words: int | None = MIN_WORDS) -> DataFrame:
    """Later copies of maximal repeated runs: (doc_id, th, start, end, first_doc, first_th, first_start), lines numbered
    from 0, end exclusive. th is xxhash64 of the text. Where a run overlaps its first copy, start is behind that copy.
    Rows without a doc_id or text take no part."""
    work = Scratch(docs.sparkSession, "lines")
    docs = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    weight = words if min_words else lambda line: line.rlike(CONTENT).cast("int")
    held = repeated_lines(work, docs, weight).drop_duplicates(["doc_id", "th", "pos"])
    ranks = global_ranks(work, "rank0", held.select("a", "b"))
    place = ["doc_id", "th", "run"]
    level = work.table("level0", held.join(ranks, ["a", "b"]).select(*place, "pos", "w", "rank"))
    work.drop("lines", "often", "held")
    spans = spans_by_words(level, place, min_words) if min_words else spans_by_content(level, place)
    spans = work.table("spans", spans.select(*place, "start", "m", F.floor(F.log2("m") + F.lit(1e-9)).cast("int").alias("k")))
    most = spans.agg(F.max("k")).first()[0]
    found = spans.select("doc_id", "th", "start", "m", F.struct("doc_id", "th", "start").alias("first")).where("false")
    for k in range((most if most is not None else -1) + 1):
        if k:  # ranks at depth 2^k from those at half of it; suffixes cut short by their run's end have none
            nxt = level.withColumn("b", F.lead("rank", 1 << (k - 1)).over(Window.partitionBy(*place).orderBy("pos"))).where("b is not null").withColumnRenamed("rank", "a")
            nxt = work.table(f"pairs{k}", nxt.select(*place, "pos", "a", "b"))
            ranks = global_ranks(work, f"rank{k}", nxt.select("a", "b"))
            level = work.table(f"level{k}", nxt.join(ranks, ["a", "b"]).select(*place, "pos", "rank"))
            work.drop(f"pairs{k}", f"rank{k}", f"level{k - 1}")
        own = spans.where(F.col("k") == k)
        one = level.select(*place, F.col("pos").alias("start"), F.col("rank").alias("a"))
        two = level.select(*place, F.col("pos").alias("end2"), F.col("rank").alias("b"))
        cover = own.join(one, [*place, "start"]).withColumn("end2", F.col("start") + F.col("m") - (1 << k)).join(two, [*place, "end2"])
        cover = work.table(f"cover{k}", cover.select(*place, "start", "m", "a", "b"))
        first = cover.groupBy("m", "a", "b").agg(F.min(F.struct("doc_id", "th", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        first = work.table(f"first{k}", first)
        later = join_counted(cover, first, ["m", "a", "b"]).where(~F.struct("doc_id", "th", "start").eqNullSafe(F.col("first")))
        found = found.unionByName(later.select("doc_id", "th", "start", "m", "first"))
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    behind = F.when(same, F.greatest(F.col("start"), F.col("first.start") + F.col("m"))).otherwise(F.col("start"))
    found = found.select("doc_id", "th", behind.alias("start"), (F.col("start") + F.col("m")).alias("end"), F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), (F.col("start") - F.col("first.start")).alias("offset")).where("start < end")
    # One exchange by text serves the merging and, in dedup_lines, the gathering of a text's lines.
    diagonal = ["doc_id", "th", "first_doc", "first_th", "offset"]
    by = Window.partitionBy(*diagonal).orderBy("start", "end")
    parted = found.repartition("doc_id", "th").withColumn("new", F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    parted = parted.withColumn("piece", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parted.groupBy(*diagonal, "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("doc_id", "th", "start", "end", "first_doc", "first_th", (F.col("start") - F.col("offset")).alias("first_start"))


def dedup_lines(docs: DataFrame, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, any others) without later copies of repeated line runs; adds n_lines and n_deleted.

    A run is consecutive lines with at least min_words words (an empty line counts one), or with min_words None any
    consecutive lines of which one has a letter or digit, repeated word for word anywhere in the corpus, the same text
    included. Its first place by (doc_id, place in the text) stays as far as this run goes (a longer or an overlapping
    run with an earlier copy elsewhere may still take lines of it); of its other places every line goes that doesn't
    lie in the first one. With None a line of neither letters nor digits goes
    only together with the nearest line with content before or after it. Lines are cut at \\n
    and compared exactly. Null texts stay null with 0 lines; an empty text is one empty line. Rows without a doc_id stay
    as they are, and are no first copies. Fully repeated rows (same
    doc_id and text) share their fate; same doc_id with other texts are ordered by a hash of the text. A text that
    loses all its lines becomes empty; its row stays. Columns n_lines and n_deleted of docs itself are replaced.
    """
    gone = repeated_runs(docs, min_words).groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))))).alias("gone"))
    gone = Scratch(docs.sparkSession, "lines").table("gone", gone)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    others = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    joined = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("t"), others)
    joined = joined.join(gone.hint("merge"), (F.col("id") == F.col("doc_id")) & (F.col("h") == F.col("th")), "left")
    lines = F.split("t", "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("text")
    out = [text if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return joined.select(*out, F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"))
