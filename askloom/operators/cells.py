"""Nearest neighbours through an index of cells: exact by the triangle inequality, or approximate in a few cells.

Each vector lies in the cell of its nearest centre, and vectors are stored cell by cell. With the distance ``a`` of a
question to a centre and the radius ``r`` of its cell, nothing in the cell is nearer than ``a - r``. Angles stand for the
cosine distance and Euclidean lengths for ``l2``; an inner product obeys no triangle inequality and has no such index.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.operators.search import BROADCAST_BYTES, CELL_BYTES, CELL_ROWS, SCORES, _cells, _score, _top
from askloom.options import SearchOptions
from askloom.schemas import HITS
from askloom.session import materialize

SPACES = ("cosine", "l2")
# Centres are fitted on a sample of at most so many vectors and bytes; every vector is in the index.
SAMPLE_ROWS = 32_768
SAMPLE_BYTES = 64 * 1024 * 1024
ROUNDS = 8
# Bound of the cells, hence of the folders of an index and of the centres that each task holds.
MOST_CELLS = 4_096
CENTRE_BYTES = 64 * 1024 * 1024
# Pairs of question and cell that may be broadcast.
BROADCAST_PAIRS = 4_000_000
# Cells that an exact search looks in first, to learn how far the others matter.
FIRST_CELLS = 4
# Distances count by six digits; this also covers the rounding of angles and lengths.
SLACK = 1e-6
# Scores that stay in a processor's cache while the nearest of many centres is found.
CACHED_SCORES = 250_000


def _apart(points: np.ndarray, centres: np.ndarray, space: str) -> np.ndarray:
    """Angles or lengths between points, down, and centres, across."""
    products = points @ centres.T
    if space == "cosine":
        return np.arccos(np.clip(products, -1, 1))
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * products, 0))


def _nearest(points: np.ndarray, centres: np.ndarray, space: str) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its angle or length, which is computed of no other centre."""
    cell, apart = np.zeros(len(points), np.int32), np.zeros(len(points))
    squares = None if space == "cosine" else (centres**2).sum(1)[None, :]
    step = max(1, CACHED_SCORES // max(len(centres), 1))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        scores = part @ centres.T
        if squares is not None:
            scores = 2 * scores - squares
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(part)), best]
        cell[at : at + step] = best
        if squares is None:
            apart[at : at + step] = np.arccos(np.clip(top, -1, 1))
        else:
            apart[at : at + step] = np.sqrt(np.maximum((part**2).sum(1) - top, 0))
    return cell, apart


def _points(vectors: pa.Array, dim: int, space: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has distances (right size, finite, for angles not zero), and these vectors; for angles of length 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    lengths = np.linalg.norm(values, axis=1)
    good = np.isfinite(lengths) & ((lengths > 0) | (space != "cosine"))
    rows, values = rows[good], values[good]
    return rows, values / lengths[good, None] if space == "cosine" else values


def _centres(points: np.ndarray, n: int, space: str, seed: int = 11) -> np.ndarray:
    """k-means centres of a sample; a centre that loses all its points stays where it was."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]].copy()
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        cell, _ = _nearest(points, centres, space)
        np.add.at(sums, cell, points)
        counts = np.bincount(cell, minlength=len(centres))
        if space == "cosine":
            lengths = np.linalg.norm(sums, axis=1)
            moved = lengths > 1e-9
            centres[moved] = sums[moved] / lengths[moved, None]
        else:
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def write_cells(
    vectors: DataFrame, path: str, cells_path: str, *, dim: int, space: str = "cosine", cells: int | None = None, file_rows: int = CELL_ROWS
) -> None:
    """Store ``vectors`` (``chunk_id, embedding``, others stay) by cell at ``path``, and the cells at ``cells_path``.

    ``vectors`` is read three times, so it should be a stored table. ``cells`` is the number of cells, by default the square
    root of the number of rows. A vector without distances (null, another size than ``dim``, not finite, zero for ``cosine``)
    is kept in cell -1, which no search reads. A large cell gets as many files as it needs, as the sample tells, each from
    its own task, so vectors are dealt to cells in one pass.
    """
    if space not in SPACES:
        raise ValueError(f"an index needs one of {SPACES}, got {space!r}")
    spark = vectors.sparkSession
    n, n_sized = vectors.agg(F.count("*"), F.count_if(F.size("embedding") == dim)).first()
    wanted = cells or isqrt(n)
    wanted = max(1, min(wanted, MOST_CELLS, CENTRE_BYTES // (8 * dim)))
    sized = vectors.where(F.size("embedding") == dim).select("embedding", F.xxhash64("chunk_id").alias("_at"))
    sample = sized.orderBy("_at").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).select("embedding").toArrow()
    points = _points(sample.column(0), dim, space)[1]
    centres = _centres(points, wanted, space)
    # files by cell, that of cell -1 last
    sampled = np.bincount(_nearest(points, centres, space)[0], minlength=len(centres)) if len(points) else np.zeros(0)
    held = np.append(sampled, sample.num_rows - len(points)) * (n_sized / max(1, sample.num_rows))
    held[-1] += n - n_sized
    shared = spark.sparkContext.broadcast((centres, np.maximum(1, np.ceil(held / file_rows)).astype(np.int32)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, files = shared.value
        step = max(1, SCORES // dim)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, points = _points(part.column("embedding"), dim, space)
                cell, far = np.full(part.num_rows, -1, np.int32), np.zeros(part.num_rows)
                if len(rows) and len(centres):
                    cell[rows], far[rows] = _nearest(points, centres, space)
                columns = [*part.columns, pa.array(cell), pa.array(far), pa.array(files[cell])]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "cell", "apart", "_files"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    dealt = vectors.mapInArrow(deal, f"{kept}, cell int, apart double, _files int")
    spread = dealt.withColumn("_file", F.pmod(F.xxhash64("chunk_id"), F.col("_files")).cast("int"))
    spread.repartition("cell", "_file").drop("_files", "_file").write.partitionBy("cell").parquet(path)
    # radii of what was written: a vector halfway between two centres may be dealt otherwise when computed again
    stored = spark.read.schema("apart double, cell int").parquet(path)
    found = stored.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    rows = [(r["cell"], r["n"], r["radius"], centres[r["cell"]].tolist(), space) for r in found]
    spark.createDataFrame(rows, "cell int, n bigint, radius double, centre array<double>, space string").coalesce(1).write.parquet(cells_path)


def _reach(distance: np.ndarray, space: str) -> np.ndarray:
    """The angle or length of a distance."""
    far = np.asarray(distance, dtype=np.float64) + SLACK
    return np.arccos(np.clip(1 - far, -1, 1)) if space == "cosine" else np.sqrt(np.maximum(far, 0))


def _reached(questions: DataFrame, cells: pa.Table, limit: Column, first: int | None, dim: int, space: str) -> DataFrame:
    """``query_id, embedding, cell``: cells that may hold something within ``limit``, or the ``first`` nearest of these."""
    number = cells.column("cell").to_numpy()
    centres = np.array(cells.column("centre").to_pylist(), dtype=np.float64).reshape(len(number), dim)
    shared = questions.sparkSession.sparkContext.broadcast((number, cells.column("radius").to_numpy(), centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, radius, centres = shared.value
        step = max(1, SCORES // max(len(number), dim))
        for batch in batches:
            for at in range(0, batch.num_rows if len(number) else 0, step):
                part = batch.slice(at, step)
                rows, points = _points(part.column("embedding"), dim, space)
                apart = _apart(points, centres, space)
                scale = 1 + (np.linalg.norm(points, axis=1)[:, None] if space == "l2" else 0) + np.linalg.norm(centres, axis=1)[None, :]
                reach = _reach(part.column("_limit").to_numpy(zero_copy_only=False)[rows], space)
                near = apart - radius[None, :] <= reach[:, None] + SLACK * scale
                if first and first < len(number):
                    nth = np.partition(np.where(near, apart, np.inf), first - 1, axis=1)[:, first - 1]
                    near &= apart <= nth[:, None]
                q, c = np.nonzero(near)
                taken = part.select(["query_id", "embedding"]).take(pa.array(rows[q]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(number[c], pa.int32())], ["query_id", "embedding", "cell"])

    kind = questions.schema["embedding"].dataType.simpleString()
    asked = questions.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding", limit.cast("double").alias("_limit"))
    return asked.mapInArrow(run, f"query_id bigint, embedding {kind}, cell int")


def _hits_in(stored: DataFrame, cells: DataFrame, asked: DataFrame, k, limit: float, space: str, dim: int, cell_rows: int, most_pairs: int) -> DataFrame:
    """Hits of stored pairs of question and cell: only the folders of these cells are read.

    Few pairs are broadcast, so that no vector is shuffled; otherwise both sides meet in bounded parts of cells.
    """
    spark = stored.sparkSession
    counts = asked.groupBy("cell").agg(F.count("*").alias("asked")).collect()  # one row per cell
    offered = stored.where(F.col("cell").isin([r["cell"] for r in counts])).select("chunk_id", "embedding", "cell")
    n_pairs = sum(r["asked"] for r in counts)
    questions = asked.select("query_id", "embedding").dropDuplicates(["query_id"])
    if n_pairs <= most_pairs and questions.count() <= max(1, BROADCAST_BYTES // (8 * dim)):
        found = questions.toArrow()
        ids = found.column("query_id").to_numpy()
        values = found.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        pairs = asked.select("cell", "query_id").toArrow()
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], pairs.column("query_id").to_numpy())] if len(ids) else np.empty(0, np.int64)
        by_cell = np.lexsort((at, pairs.column("cell").to_numpy()))
        shared = spark.sparkContext.broadcast((ids, values.reshape(len(ids), dim), pairs.column("cell").to_numpy()[by_cell], at[by_cell]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, cell, row = shared.value
            for batch in batches:
                own = batch.column("cell").to_numpy()
                for here in np.unique(own):
                    rows = row[np.searchsorted(cell, here) : np.searchsorted(cell, here, side="right")]
                    part = batch.select(["chunk_id", "embedding"]).take(pa.array(np.flatnonzero(own == here)))
                    yield from _score([part], ids[rows], matrix[rows], k, limit, space, dim)

        return offered.mapInArrow(run, HITS)
    cell_rows = max(1, min(cell_rows, CELL_BYTES // (8 * dim)))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_nq"))
    parts = parts.join(cells.select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("_nc")), "cell")

    def placed(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        dealt = df.join(F.broadcast(parts), "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    left = placed(offered, "chunk_id", "_c", "_nc", "_q", "_nq")
    right = placed(asked, "query_id", "_q", "_nq", "_c", "_nc")
    return _cells(left, right, ["cell", "_c", "_q"], k, limit, space, dim)


def nearest_in_cells(
    spark: SparkSession,
    path: str,
    cells_path: str,
    questions: DataFrame,
    opts: SearchOptions = SearchOptions(),
    *,
    dim: int,
    cell_rows: int = CELL_ROWS,
    most_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Hits as of ``search.nearest``, from an index: exact, or with ``opts.approximate`` from that many cells per question.

    An exact top-k first looks in a few near cells; the distance of the ``k``-th hit there tells which others can hold a
    nearer vector. Questions without a usable vector have no hits.
    """
    if opts.n_results == "all":
        raise ValueError("n_results='all' is a plain scan: use collections.retrieve_all")
    cells = spark.read.parquet(cells_path)
    table = cells.toArrow()  # at most MOST_CELLS rows and CENTRE_BYTES
    if table.num_rows and table.column("space")[0].as_py() != opts.space:
        raise ValueError(f"the index is for {table.column('space')[0].as_py()!r}, not {opts.space!r}")
    stored = spark.read.schema("chunk_id bigint, embedding array<float>, cell int").parquet(path)
    k, limit = opts.k, float(opts.max_distance)
    first = opts.approximate or (FIRST_CELLS if k else None)
    asked = materialize(_reached(questions, table, F.lit(limit), first, dim, opts.space), "asked")
    hits = _hits_in(stored, cells, asked, k, limit, opts.space, dim, cell_rows, most_pairs)
    if k is None:
        return hits
    best = _top(hits, k)
    if opts.approximate:
        return best
    best = materialize(best.drop("rank"), "hits")
    bound = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_bound"))
    known = questions.select("query_id", "embedding").join(bound, "query_id", "left")
    further = _reached(known, table, F.coalesce("_bound", F.lit(limit)), None, dim, opts.space)
    further = materialize(further.join(asked.select("query_id", "cell"), ["query_id", "cell"], "left_anti"), "asked")
    rest = _hits_in(stored, cells, further, k, limit, opts.space, dim, cell_rows, most_pairs)
    return _top(best.unionByName(rest), k)
