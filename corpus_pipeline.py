"""The corpus pipeline: documents that are worth training on, once each, mixed and packed.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of docs. The caller may write each stage's rows and read them again;
run() does so below the shared checkpoint folder, so that a stage never runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspark.llm import cotrain, packing, patricia, raking, simhash
from lumaspark.llm.tables import Steps


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return patricia.drop_exact_duplicates(docs, keep="min")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return raking.sample_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("packing", pack)]
ORACLE_SQL = None  # tokens, trained scores and fingerprints are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other: the packed pieces."""
    steps = Steps(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = steps.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            steps.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with a digest of their ids, by document."""
    return run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"pipeline": pipeline}
SQL: dict[str, str] = {}
