"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm import linededup, mixing, ngramjoin, packing, quality
from lamella.llm.common import Scratch, read, row_hash
from lamella.llm.queries import TOKENS, WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents and the labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs of any length; those left without a letter or digit go, as
    earlier ones hold their lines.

    n_chars is counted again for texts that changed. Null and empty texts stay.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in names]).alias("row"))
    out = linededup.dedup_lines(inner, min_words=None).where((F.col("n_deleted") == 0) | F.col("text").rlike(linededup.CONTENT))
    field = lambda c: F.col("row").getField(c)
    recount = lambda c: F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(field(c)) if c == "n_chars" else field(c)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else recount(c).alias(c) for c in docs.columns])


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the first by (doc_id, hash of the text), once.

    Rows are told apart by doc_id and text, so other texts under a lost row's doc_id stay. Rows without a doc_id and
    rows without words stay; rows with equal doc_id and text, null or empty ones too, count as one document, of which
    the row with the smallest hash of all columns stays.
    """
    rows = ngramjoin.jaccard_rows(docs)
    mine = F.struct("doc_id", "text_hash")
    work = Scratch(spark, "kept")
    losers = work.table("losers", rows.where(F.col("keeper").isNotNull() & (F.col("keeper") != mine)).select("doc_id", "text_hash").distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), row_hash(docs).alias("all"), F.struct(*names).alias("row"))
    lost = (F.col("id") == losers["doc_id"]) & (F.col("h") == losers["text_hash"])
    kept = keyed.join(losers, lost, "left_anti")
    same = work.table("repeated", docs.groupBy(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("rh")).count().where("count > 1 and rid is not null").select("rid", "rh"))
    if same.isEmpty():
        return kept.select("row.*")
    twice = (F.col("id") == F.col("rid")) & (F.col("h") == F.col("rh"))
    first = Window.partitionBy("id", "h").orderBy("all")
    once = kept.join(same, twice, "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.join(same, twice, "left_anti").select("row.*").unionByName(once.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their mix_position, as files in the order of the mix of sources."""
    return mixing.in_mixed_order(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents; sequences follow the mix by ranges of mix_position."""
    return packing.pack(docs, TOKENS, order="mix_position")


STAGES: list[tuple[str, Callable]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(name, stage(spark, docs, sf_dir))
    return docs
