"""Nearest-neighbour joins of questions with a collection, scored in blocks.

Vectors are dense (``embedding``) or sparse (``buckets``, ``weights``). A block of dense chunk vectors
is multiplied with a block of question vectors in one matrix product. Of a block of sparse ones most
rows are ruled out for many questions at once (``folding``); where that leaves too many, the block is read
by the terms of each question (``postings``). Only rows that can still be a result leave the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions.vectors import DECIMALS, DISTANCES, HASH_DIM, rounded
from askloom.operators.folding import Folding, near_many
from askloom.operators.postings import Questions, Vectors, blocks_of
from askloom.options import SearchOptions
from askloom.schemas import HITS
from askloom.session import materialize

# Question blocks up to this size are broadcast; larger question sets go through the grid.
BROADCAST_BYTES = 64 * 1024 * 1024
# Scores held at a time by one task.
SCORES = 4_000_000
# Rows and bytes of one side in one grid cell.
CELL_ROWS = 32_768
CELL_BYTES = 64 * 1024 * 1024
# An entry of a sparse vector and what its row takes besides.
ENTRY_BYTES = 16
# Hits without a number of results leave a task in parts of about so many rows.
HIT_ROWS = 200_000


def _vector_columns(df: DataFrame) -> list[str]:
    return ["embedding"] if "embedding" in df.columns else ["buckets", "weights"]


def _present(df: DataFrame, dim: int) -> DataFrame:
    """Rows with a usable vector; a missing or odd-sized one has no distance to anything."""
    if "embedding" in df.columns:
        return df.where(F.size("embedding") == dim)
    return df.where(F.size("buckets") > 0)


def _matrix(batch: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (first column) and the double matrix of a batch of dense vectors."""
    ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns)
    ids = ids.to_numpy(zero_copy_only=False)
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)


def _distances(chunks: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    """Rounded distances, chunks down and questions across; NaN where undefined."""
    products = chunks @ questions.T
    if metric == "ip":
        d = 1 - products
    elif metric == "l2":
        d = (chunks**2).sum(1)[:, None] + (questions**2).sum(1)[None, :] - 2 * products
        d = np.maximum(d, 0.0)
    else:
        lengths = np.linalg.norm(chunks, axis=1)[:, None] * np.linalg.norm(questions, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1 - products / lengths
        d[lengths == 0] = np.nan
    return np.round(d, DECIMALS) + 0.0


class _Best:
    """The ``k`` nearest chunks per question seen so far, ties broken by chunk id."""

    def __init__(self, n_questions: int, k: int, limit: float | None):
        self.k = k
        self.bound = np.full(n_questions, np.inf if limit is None else limit)
        self.rows = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

    def add(self, ids: np.ndarray, d: np.ndarray) -> None:
        bound = self.bound
        if len(d) > self.k:
            nth = np.partition(np.where(np.isnan(d), np.inf, d), self.k - 1, axis=0)[self.k - 1]
            bound = np.minimum(bound, nth)
        at, q = np.nonzero(d <= bound)
        if not len(at):
            return
        self.merge(q, ids[at], d[at, q])

    def merge(self, q: np.ndarray, chunk: np.ndarray, dist: np.ndarray) -> None:
        q = np.concatenate([self.rows[0], q])
        dist = np.concatenate([self.rows[1], dist])
        chunk = np.concatenate([self.rows[2], chunk])
        order = np.lexsort((chunk, dist, q))
        q, dist, chunk = q[order], dist[order], chunk[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        full = place == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], dist[full])
        self.rows = (q[keep], dist[keep], chunk[keep])


def _hits(query_ids: np.ndarray, q: np.ndarray, chunk: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[q], pa.int64()), pa.array(chunk, pa.int64()), pa.array(d, pa.float64())],
        ["query_id", "chunk_id", "distance"],
    )


def _score(
    batches: Iterator, query_ids: np.ndarray, questions: np.ndarray, k: int | None, limit: float | None, metric: str, dim: int
) -> Iterator[pa.RecordBatch]:
    if not len(query_ids):
        return
    step = max(1, min(SCORES // len(query_ids), SCORES // dim))
    best = _Best(len(query_ids), k, limit) if k else None
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            ids, chunks = _matrix(batch.slice(at, step), dim)
            d = _distances(chunks, questions, metric)
            if best:
                best.add(ids, d)
                continue
            row, q = np.nonzero(~np.isnan(d) if limit is None else d <= limit)
            if len(row):
                yield _hits(query_ids, q, ids[row], d[row, q])
    if best and len(best.rows[0]):
        yield _hits(query_ids, best.rows[0], best.rows[2], best.rows[1])


def _score_sparse(
    batches: Iterator, query_ids: np.ndarray, questions: Questions, k: int | None, limit: float | None, metric: str, dim: int
) -> Iterator[pa.RecordBatch]:
    if not len(query_ids):
        return
    best, folding = _Best(len(query_ids), k, limit), None
    for block in blocks_of(batches, metric, dim):
        folding = folding or Folding(block, dim)
        found, n = [], 0

        def gathered() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(part) for part in zip(*found))

        for q, rows, d in near_many(block, folding, questions, best.bound, k):
            found.append((q, block.ids[rows], d))
            n += len(q)
            if n >= HIT_ROWS:
                if k:
                    best.merge(*gathered())
                else:
                    yield _hits(query_ids, *gathered())
                found, n = [], 0
        if found:
            if k:
                best.merge(*gathered())
            else:
                yield _hits(query_ids, *gathered())
        del block  # before the next one is made
    if len(best.rows[0]):
        yield _hits(query_ids, best.rows[0], best.rows[2], best.rows[1])


def _top(hits: DataFrame, k: int) -> DataFrame:
    """Global rank over the few candidates each task kept."""
    nearest = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _sparse_bytes(df: DataFrame) -> int:
    return df.agg(F.sum((F.size("buckets").cast("bigint") + 1) * ENTRY_BYTES)).first()[0] or 0


def _grid(chunks: DataFrame, questions: DataFrame, k: int | None, limit: float | None, metric: str, dim: int, cell_rows: int) -> DataFrame:
    """Both sides cut into blocks by id hash; each (question block, chunk block) is one bounded cell.

    Blocks follow from what the vectors take, so sparse ones, which are short, are copied to few cells.
    """

    def blocks(df: DataFrame) -> int:
        if "embedding" in df.columns:
            return -(-df.count() // max(1, min(cell_rows, CELL_BYTES // (8 * dim)))) or 1
        return -(-_sparse_bytes(df) // max(1, CELL_BYTES * cell_rows // CELL_ROWS)) or 1

    q_blocks, c_blocks = blocks(questions), blocks(chunks)

    def placed(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        )

    return _cells(
        placed(chunks, "chunk_id", "_c", c_blocks, "_q", q_blocks),
        placed(questions, "query_id", "_q", q_blocks, "_c", c_blocks),
        ["_q", "_c"], k, limit, metric, dim,
    )


def _prepared(questions: pa.Table, metric: str, dim: int):
    """The way to score these questions, and their ids and vectors as it takes them."""
    if questions.num_columns == 2:
        return _score, _matrix(questions, dim)
    vectors = Vectors(questions)
    return _score_sparse, (vectors.ids, Questions(vectors, metric))


def _cells(chunks: DataFrame, questions: DataFrame, cell: list[str], k, limit, metric: str, dim: int) -> DataFrame:
    """Score the chunks and questions that share a cell."""
    vector = _vector_columns(chunks)
    chunks = chunks.select(*cell, "chunk_id", *vector)
    # fresh aliases: both sides may stem from the same table
    questions = questions.select(*[F.col(c).alias(c) for c in (*cell, "query_id", *vector)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        score, asked = _prepared(right.select(["query_id", *vector]), metric, dim)
        table = left.select(["chunk_id", *vector])
        found = list(score(table.to_batches(), *asked, k, limit, metric, dim))
        return pa.Table.from_batches(found, schema=_hits(np.empty(0, np.int64), *[np.empty(0, np.int64)] * 2, np.empty(0)).schema)

    return chunks.groupBy(*cell).cogroup(questions.groupBy(*cell)).applyInArrow(run, HITS)


def nearest(
    chunks: DataFrame,
    questions: DataFrame,
    opts: SearchOptions = SearchOptions(),
    *,
    dim: int = HASH_DIM,
    limited: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Hits ``(query_id, chunk_id, distance[, rank])`` of many questions at once, exact.

    ``chunks``: chunk_id and a vector; ``questions``: query_id and a vector. With a number of
    results, each question keeps its nearest ``k`` within the limit and gets ranks. With ``'max'``
    every chunk within the limit is a hit; that needs no shuffle at all, and the order is that of
    ``(distance, chunk_id)`` (see ``rank_hits``). ``limited=False`` leaves the distance limit out.
    """
    if opts.n_results == "all":
        raise ValueError("n_results='all' is a plain scan: use collections.retrieve_all")
    limit = float(opts.max_distance) if limited else None
    k, metric = opts.k, opts.space
    vector = _vector_columns(chunks)
    chunks = _present(chunks.select("chunk_id", *vector), dim)
    questions = _present(questions.select("query_id", *vector), dim)
    sparse = len(vector) > 1
    most = max(1, broadcast_bytes // ((ENTRY_BYTES if sparse else 8) * dim))
    # never more than the bound plus one row reaches the driver
    head = questions.limit(most + 1).toArrow()
    if head.num_rows > most and sparse:
        # so many are few bytes all the same if they are short
        questions = materialize(questions, "asked")
        if _sparse_bytes(questions) <= broadcast_bytes:
            head, most = questions.toArrow(), questions.count()
    if head.num_rows > most:
        hits = _grid(chunks, questions, k, limit, metric, dim, cell_rows)
    else:
        shared = chunks.sparkSession.sparkContext.broadcast(head)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, asked = _prepared(shared.value, metric, dim)
            yield from score(batches, *asked, k, limit, metric, dim)

        hits = chunks.mapInArrow(run, HITS)
    return _top(hits, k) if k else hits


def rank_hits(hits: DataFrame, block: int = 65_536) -> DataFrame:
    """Add ``rank`` per question to an unbounded hit list, such as that of ``'max'``.

    A question may have hits without bound and a third of them may share one distance, so ranks are
    built from counts per (question, distance, block of chunk ids) instead of one sort per question.
    """
    placed = hits.withColumn("_block", F.floor(F.col("chunk_id") / block))
    cell = ["query_id", "distance", "_block"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_band", F.floor(F.col("distance") * 1000))
    bands = counts.groupBy("query_id", "_band").agg(F.sum("_n").alias("_n"))
    before = Window.unboundedPreceding, -1
    over_bands = Window.partitionBy("query_id").orderBy("_band").rowsBetween(*before)
    bands = bands.select("query_id", "_band", F.coalesce(F.sum("_n").over(over_bands), F.lit(0)).alias("_base"))
    in_band = Window.partitionBy("query_id", "_band").orderBy("distance", "_block").rowsBetween(*before)
    bases = counts.withColumn("_in", F.coalesce(F.sum("_n").over(in_band), F.lit(0))).join(bands, ["query_id", "_band"])
    bases = bases.select(*cell, (F.col("_base") + F.col("_in")).alias("_before"))
    in_cell = Window.partitionBy(*cell).orderBy("chunk_id")
    return placed.join(bases, cell).select(
        "query_id", "chunk_id", "distance", (F.col("_before") + F.row_number().over(in_cell)).alias("rank")
    )


def nearest_to_one(
    chunks: DataFrame, question: DataFrame, opts: SearchOptions = SearchOptions(), limited: bool = True
) -> DataFrame:
    """Top-k of a single question, dense vectors: one scalar subquery, one take-ordered pass."""
    if opts.k is None:
        raise ValueError("a single-question top-k needs a number of results")
    asked = chunks.select("chunk_id", "embedding", question.select("embedding").scalar().alias("_q"))
    distance = DISTANCES[opts.space](F.col("embedding"), F.col("_q"))
    scored = asked.select("chunk_id", rounded(distance).alias("distance")).where(F.col("distance").isNotNull())
    if limited:
        scored = scored.where(F.col("distance") <= opts.max_distance)
    return scored.orderBy("distance", "chunk_id").limit(opts.k)


def filter_by_distance(hits: DataFrame, max_distance: float) -> DataFrame:
    """Keep hits at or below the limit; other result fields are dropped."""
    kept = [c for c in ("query_id", "rank", "chunk_id", "distance", "text") if c in hits.columns]
    return hits.where(F.col("distance") <= max_distance).select(*kept)
