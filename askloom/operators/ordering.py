"""Dense positions and prefix sums without a single-task global sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

RANGES = 256


def _range_number(bounds: Column, value: Column) -> Column:
    # never NULL, so that joins on it need no filter that would compute it once more
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= value)), F.lit(0))


def exclusive_prefix(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows with a smaller ``order`` (unique per row).

    The rows are cut into ranges of about equal row count by approximate quantiles, so clustered
    order values cannot pile up in one task. Only the range totals, at most ``RANGES + 1`` rows,
    are summed in one place and broadcast.
    """
    cuts = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = df.agg(F.percentile_approx(order, cuts, F.lit(10 * RANGES)).alias("b")).scalar()
    bounded = df.withColumn("_bounds", bounds)
    ranged = bounded.withColumn("_range", _range_number(F.col("_bounds"), F.col(order))).drop("_bounds")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, (F.col("_base") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_base")
    )


def number_within(df: DataFrame, keys: list[str], order: str, block: int = 65_536) -> DataFrame:
    """Replace ``order`` by positions 0..n-1 in its order within each key (which it must be unique in).

    Positions come from counts per (key, block of order values), so one key may hold any share of the rows.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    place = [*keys, "_block"]
    counts = blocked.groupBy(*place).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*place, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(order))
    return blocked.join(bases, place).withColumn(order, F.col("_base") + inside - 1).drop("_block", "_base")


CHUNK_BLOCK = 65_536
# Chunks per partition folder of a stored collection.
SEGMENT_ROWS = 1_048_576


def segment_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / SEGMENT_ROWS).cast("int")


def assign_chunk_ids(chunks: DataFrame, block: int = CHUNK_BLOCK) -> DataFrame:
    """Dense ``chunk_id`` 0..n-1 in the order (source_ord, chunk_ord).

    The first id of each source comes from a prefix sum over one row per source. It is joined back
    per (source, block of chunks), so the chunks of one huge source spread over many tasks.
    """
    counts = chunks.groupBy("source_ord").agg(F.count("*").alias("n"))
    first = exclusive_prefix(counts, "source_ord", "n", "first_id")
    blocks = first.select(
        "source_ord",
        "first_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("_block"),
    )
    return (
        chunks.withColumn("_block", F.floor(F.col("chunk_ord") / block))
        .join(blocks, ["source_ord", "_block"])
        .withColumn("chunk_id", F.col("first_id") + F.col("chunk_ord"))
        .drop("_block", "first_id")
    )


def _part_number(sources: np.ndarray, places: np.ndarray, share: int):
    """Arrow UDF: the part of a chunk. Part k begins with chunk ``places[k]`` of source ``sources[k]``.

    The cuts inside one source lie ``share`` chunks apart.
    """

    @arrow_udf("int")
    def part(source_ord: pa.Array, chunk_ord: pa.Array) -> pa.Array:
        s, c = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (source_ord, chunk_ord))
        before = np.searchsorted(sources, s, "left")
        at = np.minimum(before, len(sources) - 1)
        inside = np.where((sources[at] == s) & (c >= places[at]), (c - places[at]) // share + 1, 0)
        return pa.array(before + inside - 1, pa.int32())

    return part


def dense_layout(chunks: DataFrame, total: int, parts: int) -> DataFrame:
    """Chunks with dense ``chunk_id`` in the order (source_ord, chunk_ord), in partitions of consecutive ids.

    The texts are shuffled once. Where each part begins follows from the number of chunks per source
    alone: one row per part reaches the driver. Within a part, ids follow from the sorted place.
    """
    share = -(-total // parts)
    counts = chunks.groupBy("source_ord").agg(F.count("*").alias("n"))
    first = exclusive_prefix(counts, "source_ord", "n", "first_id")
    low, high = F.ceil(F.col("first_id") / share), F.floor((F.col("first_id") + F.col("n") - 1) / share)
    cuts = first.select("source_ord", "first_id", F.explode_outer(F.when(low <= high, F.sequence(low, high))).alias("k"))
    found = cuts.where("k IS NOT NULL").select("k", "source_ord", (F.col("k") * share - F.col("first_id")).alias("place")).toArrow()
    order = np.argsort(found.column("k").to_numpy())
    sources, places = (found.column(c).to_numpy()[order] for c in ("source_ord", "place"))
    placed = chunks.withColumn("_part", _part_number(sources, places, share)("source_ord", "chunk_ord"))
    spread = placed.repartitionById(parts, F.col("_part")).sortWithinPartitions("source_ord", "chunk_ord")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spread.withColumn("chunk_id", F.col("_part").cast("bigint") * share + inside).drop("_part")


def with_segments(df: DataFrame, key: str, order: str, size: int, before: int, after: int) -> DataFrame:
    """Cut the rows of each key into segments of ``size`` rows plus copies of the neighbours.

    A window over (key, ``_segment``) that looks at most ``before`` rows back and ``after`` rows
    ahead gives, on rows with ``_own``, what a window over the whole key would. ``order`` must be an
    integer column, unique per key; a null comes first, and a null key is a key of its own.
    """
    if max(before, after) > size:
        raise ValueError("the window must not reach beyond the neighbouring segment")
    blocked = df.withColumn("_block", F.floor(F.col(order) / size))
    counts = blocked.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    placed = blocked.join(bases, same).drop("_key", "_of").withColumn(
        "_pos", F.col("_base") + F.row_number().over(inside) - 1
    )
    segment = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") % size
    copies = F.filter(
        F.array(
            F.struct(segment.alias("s"), F.lit(True).alias("own")),
            F.when(offset >= size - before, F.struct((segment + 1).alias("s"), F.lit(False).alias("own"))),
            F.when(offset < after, F.struct((segment - 1).alias("s"), F.lit(False).alias("own"))),
        ),
        lambda c: c.isNotNull(),
    )
    return (
        placed.withColumn("_copy", F.explode(copies))
        .withColumn("_segment", F.col("_copy.s"))
        .withColumn("_own", F.col("_copy.own"))
        .drop("_copy", "_block", "_base", "_pos")
    )
