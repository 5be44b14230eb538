"""Where intermediate tables go, and how a lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder.

    A local folder is made only where the session names none and runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="askloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Later readers get column pruning and filter pushdown, and a lost executor costs a re-read of
    one file split instead of a re-run of the whole plan.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Tasks per core that list folders.
LISTING_TASKS = 8


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While this holds, folders are listed by some tasks per core, and not by one per folder (10,000 at most)."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan for map-only work: an input of fewer splits than cores is spread over them.

    A large input has more splits than cores and is read as it is, without a shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
