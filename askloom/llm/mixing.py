"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is repeated a Poisson number of times whose mean is the repetition rate of its source, so
that the mixture has the target weights in the mean and no source is ordered or cut. The number is the
inverse of the Poisson distribution at a uniform number hashed from the seed and the document, so a
rerun of a lost task gives the same copies. Copies are then dealt out and sorted by a hash of their own:
a global shuffle that does not depend on how the input was split.

Rates come from one row per source. They are joined to the documents by a broadcast only after their
number was counted; beyond ``BROADCAST_SOURCES`` the join is an ordinary one, in which adaptive
execution splits a source that holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.frames import table

SEED = 20260
# Target weight of a source: its number of documents to this power, which raises small sources.
POWER = 0.7
# Mean size of the mixture in documents, as a share of the input.
SCALE = 1.0
BROADCAST_SOURCES = 100_000
# Above this mean the draw is a sum of several smaller ones, since exp(-mean) would vanish.
LARGEST_MEAN = 64
# More terms than any draw of that mean has in double precision.
TERMS = 256


def natural_targets(docs: DataFrame, power: float = POWER) -> DataFrame:
    """``source, weight`` with weight = documents ** power."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, targets: DataFrame, scale: float = SCALE) -> DataFrame:
    """``source, rate``: mean copies per document so that sources get their share of the mixture.

    Sources without a target, or with a null, negative or zero one, get rate 0. A null source is a
    source like any other.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    wanted = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    wanted = wanted.withColumnRenamed("source", "_source")
    both = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left")
    both = both.select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = both.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn"))  # one row
    share = F.when(F.col("sw") > 0, F.col("w") / F.col("sw")).otherwise(0.0)
    return both.join(F.broadcast(total), F.lit(True)).select("source", (share * F.col("sn") * scale / F.col("n")).alias("rate"))


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from 52 bits of the MD5 of the parts."""
    digits = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def distribution(mean: Column) -> Column:
    """Poisson distribution function at 0, 1, ... as far as it still grows in double precision."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("below"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(s["below"], F.array(F.element_at(s["below"], -1) + p)).alias("below"))

    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["below"]))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Rates with the number of draws they are split into and the distribution function of one draw."""
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    split = rates.withColumn("parts", parts)
    return split.withColumn("below", distribution(F.col("rate") / F.col("parts")))


def copies_of(identity: Column, rate: Column, parts: Column, below: Column, seed: int = SEED) -> Column:
    """Number of copies of a document: per draw, the places where the distribution function is not above its number.

    The numbers are an array of their own, so each is hashed once and not once per comparison.
    """
    numbers = F.transform(F.sequence(F.lit(1), parts), lambda i: uniform(F.lit(str(seed)), identity, i.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(below, lambda f: f <= u)))
    return F.when(rate <= 0, 0).otherwise(drawn)


def mix(docs: DataFrame, targets: DataFrame | None = None, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``source``) repeated and shuffled, with ``_copy`` (from 1) and ``_order``.

    Rows that share an id are repeated alike; a null id is an id like any other. Texts take no part in
    the draw, so null, empty and very long ones are treated alike. An empty table gives no rows. The
    result is sorted by ``_order`` within each partition and dealt over the partitions by it. Other columns may
    have any name but these two, which are refused.
    """
    if {"_copy", "_order"} & set(docs.columns):
        raise ValueError("_copy and _order are columns of the result")
    return _mixed(docs, targets, scale, seed).select("_row.*", "_copy", "_order")


def _mixed(docs: DataFrame, targets: DataFrame | None, scale: float, seed: int) -> DataFrame:
    """The mixture with the rows as they came in the one column ``_row``, so that none of their names can clash."""
    docs = docs.select("doc_id", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    rates = repetition_rates(docs, natural_targets(docs) if targets is None else targets, scale)
    rates = with_distribution(rates).toDF("_source", "_rate", "_parts", "_below")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    # one copy count per row: the generator reads it from a column of its own
    drawn = drawn.withColumn("_n", copies_of(identity, *map(F.col, ("_rate", "_parts", "_below")), seed))
    drawn = drawn.drop("_source", "_rate", "_parts", "_below")
    many = F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n")))
    repeated = drawn.withColumn("_copy", F.explode_outer(many)).where(F.col("_copy").isNotNull()).drop("_n")
    digits = F.md5(F.concat_ws(":", F.lit(f"{seed} order"), identity, F.col("_copy").cast("string")).cast("binary"))
    ordered = repeated.withColumn("_order", F.conv(F.substring(digits, 1, 15), 16, 10).cast("bigint"))
    return ordered.repartition("_order").sortWithinPartitions("_order")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"), "text")


def replicate(docs: DataFrame) -> DataFrame:
    """The mixture with the columns of ``docs`` only, whatever their names; see :func:`mix`."""
    return _mixed(docs, None, SCALE, SEED).select("_row.*")
