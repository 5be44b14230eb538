"""Connected components of a link table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from askloom.session import new_table_path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link that is not the smallest of its component.

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller ones;
    the links become stars around the smallest node within a number of rounds that grows with the
    logarithm of the node count. A round is written to the shared folder, so its lineage ends
    there. Nodes are only ever grouped by aggregation; a node with very many links meets its
    one-row minimum in a join that adaptive execution can split. Rows with a null are ignored, as
    are repeated links and links of a node to itself; no links give no rows.
    """
    spark = links.sparkSession
    at, seen = None, None
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.where(F.col("u") != F.col("v")).distinct()
    while True:
        if at is not None:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            near = F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
            small = large.join(low, "u").select(near).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            edges = small.where("u != v").distinct()
        seen_now = Observation()
        watched = edges.observe(seen_now, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
        at = new_table_path(spark, "components")
        watched.write.parquet(at)
        edges = spark.read.schema("u bigint, v bigint").parquet(at)
        now = (seen_now.get["n"], seen_now.get["s"])
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
