"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID drops documents that are `und` (null, empty or without a letter) and those whose best language has a score below
0.3; exact and SimHash deduplication leave one document of each group, substring deduplication cuts passages that an earlier document
has, and packing lays what is left into sequences.  Repeated rows go in the second stage; of rows with one doc_id and texts that differ
in case only, the first by text and then by the other columns stays.  Long texts are read whole.  An empty table
stays empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.llm.common import drop, marks, written
from glasshouse.llm.exact_dedup import exact_groups, normalised
from glasshouse.llm.langid import keep_identified, train
from glasshouse.llm.packing import pack
from glasshouse.llm.simhash import near_groups
from glasshouse.llm.substring_dedup import dedup_passages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by a model fitted on a bounded sample of the labelled ones."""
    return keep_identified(spark, docs, train(spark, docs))


def _row(docs: DataFrame):
    """All columns as one, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat it, one.  Only rows that may go are shuffled."""
    groups = written(spark, exact_groups(spark, docs).select("doc_id", "digest", "kept"), "groups")
    gone = groups.where("NOT kept").select("digest", "doc_id").distinct()
    again = groups.where("kept").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "doc_id")
    touched = marks(spark, gone.unionByName(again).select(F.xxhash64("digest", "doc_id").alias("key")))
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"), normalised()[1].alias("hash"))
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("end")))
    first = F.row_number().over(Window.partitionBy("hash", "id").orderBy("row.text", others))
    some = rows.where(touched(F.xxhash64("hash", "id"))).join(gone, (F.col("hash") == F.col("digest")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_anti")
    one = some.withColumn("place", first).where("place = 1")
    return rows.where(~touched(F.xxhash64("hash", "id"))).select("row.*").unionByName(one.select("row.*"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id; rows without a doc_id stay.  Only rows that may go are shuffled."""
    gone = written(spark, near_groups(spark, docs).where("doc_id != component_id").select("doc_id").distinct(), "gone")
    touched = marks(spark, gone.select(F.xxhash64("doc_id").alias("key")))
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"))
    stay = rows.where(touched(F.xxhash64("id"))).join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    return rows.where(~touched(F.xxhash64("id"))).select("row.*").unionByName(stay.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; n_chars follows the text."""
    return dedup_passages(spark, docs, rewrite=True, length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash", simhash),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Language ID and SimHash components are beyond SQL; tests/llm/test_pipeline.py holds run() after language ID against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(spark, stage(spark, docs, sf_dir), name)
        if before is not read:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
