"""Exact top-k search by tiled matrix products.

Queries and vectors are dealt into groups and shards of bounded size by a hash of their id; each pair of a
group and a shard is one cell, where tiles of both are multiplied and only the best ``k`` candidates
of each query are kept, tile by tile. The lists of a query then meet in a tree: ``FAN`` shards at a time,
level by level, never all at once in one task. What a task holds depends on the tile sizes, not on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from askloom.llm.frames import runs, table, whole_groups
from askloom.llm.vectors import largest_size, matrix, one_per_id, usable
from askloom.session import materialize

K = 5
LEVELS = 256  # a component x becomes floor(LEVELS * x)
GROUP_ROWS = 4096
SHARD_ROWS = 16384
TILE = (1024, 2048)
FAN = 16


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers held as doubles, exact whatever their size."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2**53:
        return a @ b.T
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def best(scores: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores per row, the first column winning ties; not where ``own``."""
    if scores.dtype != object:
        low = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
    else:
        low = float("-inf")
    scores[own] = low
    free = scores.shape[1] - own.sum(axis=1)
    rows, columns = [], []
    every = np.arange(len(scores))
    for i in range(min(k, scores.shape[1])):
        top = scores.argmax(axis=1)
        real = free > i
        rows.append(every[real])
        columns.append(top[real])
        scores[every, top] = low
    return np.concatenate(rows), np.concatenate(columns)


def _search_cells(k: int, dim: int, tile: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["g", "s"]):
            g, s = rows.column("g").to_numpy(), rows.column("s").to_numpy()
            query = rows.column("query").to_numpy(zero_copy_only=False).astype(bool)
            ids = rows.column("vec_id").to_numpy()
            values = np.floor(LEVELS * matrix(rows.column("embedding"), dim))
            edges = runs(g, s)
            for first, last in zip(edges[:-1], edges[1:]):
                own = np.arange(first, last)
                asked, held = own[query[first:last]], own[~query[first:last]]
                held = held[np.argsort(ids[held], kind="stable")]
                for q0 in range(0, len(asked), tile[0]):
                    q = asked[q0 : q0 + tile[0]]
                    found: list[tuple] = []
                    for v0 in range(0, len(held), tile[1]):
                        v = held[v0 : v0 + tile[1]]
                        scores = products(values[q], values[v])
                        kept = scores.copy()
                        r, c = best(kept, k, ids[q][:, None] == ids[v][None, :])
                        found.append((r, ids[v][c], scores[r, c]))
                    if not found:
                        continue
                    r, c, x = (np.concatenate(p) for p in zip(*found))
                    exact = np.array([int(n) for n in x], dtype=object) if x.dtype == object else x.astype(np.int64)
                    if exact.dtype == object:
                        exact = np.array([min(max(n, -(2**63)), 2**63 - 1) for n in exact], dtype=np.int64)
                    order = np.lexsort((c, -x if x.dtype.kind == "f" else ~exact, r))
                    r, c, exact = r[order], c[order], exact[order]
                    begin = runs(r)
                    place = np.arange(len(r)) - np.repeat(begin[:-1], np.diff(begin))
                    keep = place < k
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[q][r[keep]]),
                            pa.array(np.full(int(keep.sum()), s[first], dtype=np.int32)),
                            pa.array(c[keep]),
                            pa.array(exact[keep]),
                        ],
                        names=["query_id", "s", "vec_id", "score"],
                    )

    return run


def exact_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = K,
    group_rows: int = GROUP_ROWS,
    shard_rows: int = SHARD_ROWS,
    tile: tuple[int, int] = TILE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Both tables have ``vec_id, embedding``. A query is not its own candidate; equal scores go to the
    smaller id. Vectors that are null or hold a null or non-finite component take no part; shorter
    vectors are filled up with zeros; rows that share an id count once, the smallest vector; rows
    without an id are left out. Scores beyond 64 bits are ranked within a tile by their true value
    and returned as the nearest 64-bit number. Other columns are ignored; an empty table gives no rows.
    """
    held = materialize(one_per_id(vectors).where(usable(F.col("embedding"))), "vectors")
    asked = materialize(one_per_id(queries).where(usable(F.col("embedding"))), "queries")
    n, dim = largest_size(held)
    m, dim_asked = largest_size(asked)
    groups, shards = max(1, -(-m // group_rows)), max(1, -(-n // shard_rows))
    dealt = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select(dealt(groups, 1).alias("g"), every(shards).alias("s"), F.lit(True).alias("query"), "vec_id", "embedding")
    right = held.select(dealt(shards, 2).alias("s"), every(groups).alias("g"), F.lit(False).alias("query"), "vec_id", "embedding")
    cells = left.unionByName(right).repartition("g", "s").sortWithinPartitions("g", "s")
    lists = cells.mapInArrow(
        _search_cells(k, max(dim, dim_asked), tile), "query_id bigint, s int, vec_id bigint, score bigint"
    )
    return merged(lists, k, shards)


def merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """Tree merge of the per-shard lists ``query_id, s, vec_id, score`` into the best ``k`` with their rank."""

    def level(rows: DataFrame, *keys: str | Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    while shards > FAN:
        shards = -(-shards // FAN)
        lists = level(lists.withColumn("s", F.floor(F.col("s") / FAN).cast("int")), "query_id", "s").drop("rank")
    return level(lists, "query_id").select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)
