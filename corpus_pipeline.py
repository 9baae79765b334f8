"""A corpus pipeline of four stages over ``documents``.

Quality resampling drops documents that are more likely bad than good, SimHash
keeps one document of each group of near-duplicates, suffix arrays take
repeated passages out of what is left, and packing puts it into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mail, packing, quality, simhash, substrings
from gridloom.llm.shared import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model draws; those that it rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has too; n_chars counts what is left."""
    out = substrings.clean(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each sequence goes: bucket, batch and slot."""
    return packing.pack(docs.select("doc_id", packing.token_count().alias("n_tokens")))


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("repeated_substrings", without_repeats), ("packing", batches)]

#: SQL can express neither the suffix arrays nor the models; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with mail.released():
            docs = stored(stage(spark, docs, sf_dir))
    return docs
