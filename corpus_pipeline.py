"""A corpus pipeline over `documents`: stages by the operators of reverbtable.llm, each written and read again.

All stages but the last return the columns of documents. No stage fails on nulls, empty texts, repeated rows or an
empty table; what each does with them is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reverbtable.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from reverbtable.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which nothing is left (another copy keeps it all) goes too."""
    cut = line_dedup.dedup(docs)
    left = (F.col("n_dropped") == 0) | (F.length(F.translate("text", line_dedup.WHITE, "")) > 0)
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packed)]

ORACLE_SQL = None  # learned rules, latent retrieval and packing have no SQL form; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
