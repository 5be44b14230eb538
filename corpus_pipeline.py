"""Documents to token ids in five stages; each stage is written and the next one reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.bpe import encode
from askloom.llm.mixing import replicate
from askloom.llm.near_duplicates import keep_representatives
from askloom.llm.quality import accept
from askloom.llm.substring_dedup import drop_repeated_passages
from askloom.session import new_table_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels of those it is given.

    Null, empty and long texts are scored like any other; repeated rows stay or go together; further columns stay.
    """
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; see ``drop_repeated_passages`` for odd rows."""
    return drop_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order; columns may have any name."""
    return replicate(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, and a digest of the text that they decode to.

    Repeated rows are encoded each, null and empty texts have no tokens, long ones are encoded whole; the text and
    further columns are not carried on.
    """
    ids, text = F.col("_ids"), F.sha2(F.col("_decoded"), 256)
    both = encode(docs.select("doc_id", "lang", "source", "text"), decoded=True)
    return both.select("doc_id", "lang", "source", F.size(ids).cast("bigint").alias("n_tokens"), ids.alias("ids"), text.alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

# The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
