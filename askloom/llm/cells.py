"""Embedding near-duplicates: spherical k-means cells, cosine products in blocks, components of links.

1. Equal vectors become one representative with a count, so exact copies are never compared.
2. ``CLUSTERINGS`` independent spherical k-means are fitted on a bounded sample: at most ``SAMPLE_ROWS`` rows chosen by
   a hash of their id, the rounds of Lloyd's method being Spark jobs over it. The number of cells grows with the
   square root of the number of vectors up to ``MOST_CELLS``; cells of any size are handled.
3. Every vector goes to its nearest ``NEAR`` cells of each clustering, less those that no vector within the
   wanted angle can have as its nearest. A pair is found if it shares a cell in any clustering; the
   share of pairs at the limit itself that is found is measured in the tests.
4. A cell is cut into blocks of bounded size; each pair of its blocks is one task unit, in which all cosines
   are computed in double precision. A pair that shares several cells counts in the smallest one. A task
   emits a row per vector with the number of its partners and one link, never pairs.
5. The links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.components import components
from askloom.llm.frames import binary_rows, packed, runs, smallest_reachable, table, whole_groups
from askloom.llm.vectors import largest_size, matrix, one_per_id, usable
from askloom.session import materialize

SIMILAR = 0.95
CLUSTERINGS = 3
NEAR = 3
SAMPLE_ROWS = 50_000
MOST_CELLS = 4096
ROUNDS = 5
BLOCK_ROWS = 2048
STRIPE = 128


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sums(centres: np.ndarray, cells: int, dim: int):
    """Rows of the sample to the sum of the vectors nearest to each centre, one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), dim))
        for batch in batches:
            x = unit(matrix(batch.column("embedding"), dim))
            for c in range(0, len(centres), cells):
                nearest = c + (x @ centres[c : c + cells].T).argmax(axis=1)
                order = np.argsort(nearest, kind="stable")
                begin = runs(nearest[order])
                if len(order):
                    total[nearest[order][begin[:-1]]] += np.add.reduceat(x[order], begin[:-1])
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([packed(flat, np.array([0, len(flat)]))], names=["sums"])

    return run


def fit_cells(reps: DataFrame, n: int, dim: int, clusterings: int = CLUSTERINGS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of all clusterings below each other; their number is bounded, so they travel with the tasks."""
    cells = int(min(MOST_CELLS, max(1, round(n**0.5))))
    share = max(1, -(-n // SAMPLE_ROWS))
    sample = materialize(reps.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(share)) == 0).select("rep", "embedding"), "sample")
    first = []
    for c in range(clusterings):
        seeds = sample.orderBy(F.xxhash64("rep", F.lit(c)), "rep").limit(cells).select("embedding").toArrow()
        x = unit(matrix(seeds.column("embedding"), dim))
        first.append(x[np.arange(cells) % max(len(x), 1)] if len(x) else np.zeros((cells, dim)))
    centres = np.concatenate(first)
    for _ in range(rounds):
        parts = sample.mapInArrow(_sums(centres, cells, dim), "sums binary").toArrow()
        values, _ = binary_rows(parts.column("sums"), np.float64)
        total = values.reshape(-1, *centres.shape).sum(axis=0)
        filled = (total != 0).any(axis=1)
        centres[filled] = unit(total[filled])
    return centres


def _assign(centres: np.ndarray, cells: int, dim: int, near: int, similar: float):
    """Rows of representatives to one row per cell, with the sorted list of all cells of the vector."""
    reach = 2 * np.arccos(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            lists = []
            for c in range(0, len(centres), cells):
                angle = np.arccos(np.clip(unit(x) @ centres[c : c + cells].T, -1, 1))
                take = min(near, cells)
                some = np.argpartition(angle, take - 1, axis=1)[:, :take]
                far = np.take_along_axis(angle, some, axis=1)
                drop = far > far.min(axis=1, keepdims=True) + reach + 1e-9
                lists.append(np.where(drop, -1, some + c))
            lists = np.sort(np.concatenate(lists, axis=1), axis=1).astype(np.int32)
            row, column = np.nonzero(lists >= 0)
            width = lists.shape[1]
            every = packed(lists.reshape(-1), np.arange(len(x) + 1) * width)
            data = packed(x.reshape(-1), np.arange(len(x) + 1) * dim)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists[row, column]), batch.column("rep").take(at), batch.column("n").take(at), every.take(at), data.take(at)],
                names=["cell", "rep", "n", "cells", "vector"],
            )

    return run


def _compare(dim: int, similar: float):
    """Rows of block pairs to ``rep, partners, link`` of the vectors that have partners there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "i", "j"]):
            cell, i, j, block, rep, n = (
                rows.column(c).to_numpy() for c in ("cell", "i", "j", "block", "rep", "n")
            )
            values, _ = binary_rows(rows.column("vector"), np.float64)
            x = unit(values.reshape(-1, dim))
            lists, _ = binary_rows(rows.column("cells"), np.int32)
            lists = lists.reshape(len(rep), -1)
            edges = runs(cell, i, j)
            for first, last in zip(edges[:-1], edges[1:]):
                own = np.arange(first, last)
                a = own[block[first:last] == i[first]]
                b = own[block[first:last] == j[first]]
                same = i[first] == j[first]
                partners = np.zeros(last - first)
                left, right = [], []
                for at in range(0, len(a), STRIPE):
                    stripe = a[at : at + STRIPE]
                    r, c = np.nonzero(x[stripe] @ x[b].T >= similar)
                    r, c = stripe[r], b[c]
                    other = r != c
                    r, c = r[other], c[other]
                    if not len(r):
                        continue
                    left.append(r - first)
                    right.append(c - first)
                    earlier = np.zeros(len(r), dtype=bool)
                    for p in range(lists.shape[1]):
                        mine = lists[r, p]
                        before = (mine >= 0) & (mine < cell[first])
                        if before.any():
                            earlier |= before & (lists[c] == mine[:, None]).any(axis=1)
                    r, c = r[~earlier], c[~earlier]
                    partners += np.bincount(r - first, n[c], last - first)
                    if not same:
                        partners += np.bincount(c - first, n[r], last - first)
                if not left:
                    continue
                label = smallest_reachable(last - first, np.concatenate(left), np.concatenate(right))
                mine = rep[first:last]
                linked = np.flatnonzero((label != np.arange(last - first)) | (partners > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[linked]), pa.array(partners[linked].astype(np.int64)), pa.array(mine[label[linked]])],
                    names=["rep", "partners", "link"],
                )

    return run


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, near: int = NEAR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector of ``vectors`` (``vec_id, embedding``).

    Vectors are linked from cosine ``similar`` on. Null and zero vectors and those with null or non-finite
    components link with nothing; shorter vectors are filled up with zeros. Rows that share an id count
    once, the smallest vector; rows without an id are left out; other columns are ignored; an empty
    table gives no rows.
    """
    keys = ["k1", "k2"]
    every = one_per_id(vectors).withColumns(
        {"k1": F.xxhash64("embedding", F.lit(1)), "k2": F.xxhash64(F.lit(2), "embedding")}
    )
    every = materialize(every, "vectors")
    nonzero = F.exists("embedding", lambda v: v != 0)
    fine = every.where(usable(F.col("embedding")) & nonzero)
    reps = fine.groupBy(*keys).agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("embedding").alias("embedding")
    )
    reps = materialize(reps, "representatives")
    total, dim = largest_size(reps)
    if total:
        centres = fit_cells(reps, total, dim)
        cells = len(centres) // CLUSTERINGS
        placed = reps.mapInArrow(
            _assign(centres, cells, dim, near, similar), "cell int, rep bigint, n bigint, cells binary, vector binary"
        )
        placed = materialize(placed, "placed")
        count = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        # at most CLUSTERINGS * MOST_CELLS rows
        cut = placed.join(F.broadcast(count), "cell")
        cut = cut.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        grid = cut.select("cell", "rep", "n", "cells", "vector", "block", other).select(
            "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "rep", "n", "cells", "vector", "block",
        )
        pairs = ["cell", "i", "j"]
        grid = grid.repartition(*pairs).sortWithinPartitions(*pairs)
        found = materialize(grid.mapInArrow(_compare(dim, similar), "rep bigint, partners bigint, link bigint"), "links")
    else:
        found = reps.select("rep", F.lit(0).cast("bigint").alias("partners"), F.col("rep").alias("link"))
    groups = components(found, "rep", "link")
    partners = found.groupBy("rep").agg(F.sum("partners").alias("partners"))
    tops = reps.select(*keys, "rep", "n").join(partners, "rep", "left")
    tops = tops.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        *keys,
        (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("links"),
        F.coalesce("component", "rep").alias("top"),
    )
    linked = every.select("vec_id", *keys, (usable(F.col("embedding")) & nonzero).alias("fine"))
    out = linked.join(tops, keys, "left")
    mine = lambda name, rest: F.when(F.col("fine"), F.col(name)).otherwise(rest)
    out = out.select("vec_id", mine("links", F.lit(0)).alias("n_links"), mine("top", F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
