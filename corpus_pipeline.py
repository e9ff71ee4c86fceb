"""From raw documents to mixed, tokenised training text: five corpus operators in a row.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again before the next one. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmatch.llm import bpe, common, exact_dedup, mixing, near_dedup, queries, resampling


def _identity(sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go, also where an id is null or repeats
    with other texts; rows that repeat both id and text have one verdict."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = resampling.quality_resample(docs, labels, with_digest=True).where("not kept").select(_identity(F.col("text_sha256")).alias("_key")).distinct()
    return docs.withColumn("_key", _identity(F.sha2(F.coalesce("text", F.lit("")), 256))).join(judged, "_key", "left_anti").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat both id
    and text one."""
    stays = exact_dedup.exact_dedup(docs).where("kept").select(_identity(F.col("text_sha256")).alias("_key"))
    keyed = docs.withColumn("_key", _identity(F.sha2(F.coalesce("text", F.lit("")), 256)))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return keyed.join(stays, "_key", "left_semi").withColumn("_n", first).where("_n = 1").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    gone = near_dedup.near_dedup(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of one id as often as the most
    taken of them. Rows without an id can't be told apart and are taken once."""
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").cast("int").alias("_copies"))
    joined = docs.join(copies.where("doc_id is not null"), "doc_id", "left").withColumn("_copies", F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("_copies")))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids and back."""
    return bpe.round_trip(docs, queries.RANKS, queries.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("byte-level BPE", tokenise)]

#: The first stage's model has no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
