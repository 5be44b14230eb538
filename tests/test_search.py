from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions import vectors as V
from askloom.operators import cells as cells_module
from askloom.operators.cells import nearest_in_cells, write_cells
from askloom.operators.embedding import embed_texts, hash_embed, idf_table, term_counts
from askloom.operators.lsh import nearest_approx, nearest_indexed, write_index
from askloom.operators.search import filter_by_distance, nearest, nearest_to_one, rank_hits
from askloom.options import EmbedOptions, SearchOptions
from askloom.session import new_table_path


def frames(spark, chunks: np.ndarray, questions: np.ndarray):
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chunks)], "chunk_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "query_id bigint, embedding array<float>")
    return c, q


def brute(chunks, questions, metric):
    chunks, questions = chunks.astype(np.float32).astype(float), questions.astype(np.float32).astype(float)
    if metric == "l2":
        return ((chunks[None] - questions[:, None]) ** 2).sum(-1)
    dots = questions @ chunks.T
    if metric == "ip":
        return 1 - dots
    with np.errstate(all="ignore"):
        return 1 - dots / (np.linalg.norm(questions, axis=1)[:, None] * np.linalg.norm(chunks, axis=1)[None])


def expected(chunks, questions, metric, k, limit):
    d = brute(chunks, questions, metric)
    out = []
    for q in range(len(questions)):
        ranked = sorted((round(float(x), 6) + 0.0, i) for i, x in enumerate(d[q]) if not np.isnan(x) and round(float(x), 6) <= limit)
        out += [(q, i, x) for x, i in (ranked[:k] if k else ranked)]
    return sorted(out)


def found(hits):
    return sorted((r["query_id"], r["chunk_id"], r["distance"]) for r in hits.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    chunks = rng.standard_normal((700, 8))
    chunks[100:330] = chunks[100]  # a third of all rows are copies of one another
    chunks[5] = 0
    questions = np.vstack([rng.standard_normal((20, 8)), chunks[100], np.zeros(8)])
    return chunks, questions


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("n", [1, 5, "max"])
def test_exact_search(spark, data, metric, small, n):
    """Broadcast questions and the grid for larger question sets give the brute-force result."""
    chunks, questions = data
    c, q = frames(spark, chunks, questions)
    opts = SearchOptions(n_results=n, max_distance=0.8, space=metric)
    size = dict(broadcast_bytes=8 * 8 * 4, cell_rows=9) if small else {}
    got = found(nearest(c, q, opts, dim=8, **size))
    want = expected(chunks, questions, metric, opts.k, 0.8)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_questions_and_chunks_from_one_table(spark, data):
    chunks, _ = data
    c, _ = frames(spark, chunks, chunks[:1])
    q = c.withColumnRenamed("chunk_id", "query_id")
    opts = SearchOptions(n_results=1)
    want = found(nearest(c, q, opts, dim=8))
    assert want == found(nearest(c, q, opts, dim=8, broadcast_bytes=64, cell_rows=100))
    assert (200, 100, 0.0) in want and all(r[0] != 5 for r in want)


def test_ranks_and_ties(spark):
    c, q = frames(spark, np.array([[1, 0], [1, 0], [-1, 0], [0, 1], [0, 0.0]]), np.array([[2.0, 0]]))
    top = nearest(c, q, SearchOptions(n_results=5, max_distance=2), dim=2).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"], r["distance"]) for r in top] == [(1, 0, 0.0), (2, 1, 0.0), (3, 3, 1.0), (4, 2, 2.0)]
    assert filter_by_distance(nearest(c, q, SearchOptions(n_results=5, max_distance=2), dim=2), 1.0).count() == 3


def test_range_ranks_equal_a_plain_sort(spark, data):
    chunks, questions = data
    c, q = frames(spark, chunks, questions)
    hits = nearest(c, q, SearchOptions(n_results="max", max_distance=1.2), dim=8).collect()
    want, seen = [], {}
    for r in sorted(hits, key=lambda r: (r["query_id"], r["distance"], r["chunk_id"])):
        seen[r["query_id"]] = seen.get(r["query_id"], 0) + 1
        want.append((r["query_id"], r["chunk_id"], seen[r["query_id"]]))
    ranked = rank_hits(spark.createDataFrame(hits), block=50)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in ranked.collect()) == sorted(want)


def test_wider_limits_only_add_hits(spark, data):
    chunks, questions = data
    c, q = frames(spark, chunks, questions)
    before: set = set()
    for limit in (0.1, 0.4, 0.9, 2.0):
        now = set(found(nearest(c, q, SearchOptions(n_results="max", max_distance=limit), dim=8)))
        assert before <= now and all(d <= limit for _, _, d in now)
        assert set(found(nearest(c, q, SearchOptions(n_results=3, max_distance=limit), dim=8))) <= now
        before = now


def test_single_question_plan(spark, data):
    chunks, questions = data
    c, q = frames(spark, chunks, questions)
    one = nearest_to_one(c, q.where("query_id = 0"), SearchOptions(n_results=4, max_distance=2))
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().toString()
    many = nearest(c, q.where("query_id = 0"), SearchOptions(n_results=4, max_distance=2), dim=8)
    assert sorted(r["chunk_id"] for r in one.collect()) == sorted(r["chunk_id"] for r in many.collect())


def test_all_is_not_a_search(spark, data):
    c, q = frames(spark, *data)
    with pytest.raises(ValueError):
        nearest(c, q, SearchOptions(n_results="all"), dim=8)


def test_lsh_recall_with_a_hot_bucket(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    chunks = np.repeat(centres, 20, axis=0) + 0.1 * rng.standard_normal((600, 16))
    chunks = np.vstack([chunks, np.repeat(centres[:1], 300, axis=0)])
    c, q = frames(spark, chunks, centres)
    opts = SearchOptions(n_results=5, max_distance=0.5)
    exact = set(found(nearest(c, q, opts, dim=16)))
    near = set(found(nearest_approx(c, q, opts, dim=16, bands=8, bits=4, cell_rows=16)))
    assert len(exact & near) / len(exact) >= 0.9
    assert near and all(d <= 0.5 for _, _, d in near)
    path = new_table_path(spark, "index")
    write_index(c, path, dim=16, bands=8, bits=4, file_rows=64)
    indexed = nearest_indexed(spark, path, q, opts, dim=16, bands=8, bits=4, cell_rows=16)
    assert set(found(indexed)) == near
    assert found(nearest_indexed(spark, path, q.limit(0), opts, dim=16, bands=8, bits=4)) == []
    one = nearest_indexed(spark, path, q.limit(1), opts, dim=16, bands=8, bits=4)
    scans = [line for line in one._jdf.queryExecution().toString().split("\n") if "FileScan" in line and "embedding" in line]
    assert scans and all("PartitionFilters: [(" in line for line in scans)


@pytest.mark.parametrize("space", ["cosine", "l2"])
@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("n", [1, 5, "max"])
def test_cells_are_exact(spark, data, space, small, n):
    """Copies, zero vectors, unusable ones, and both ways for questions: the brute-force result."""
    chunks, questions = data
    limit = 0.6 if space == "cosine" else 3.0
    c, q = frames(spark, chunks, questions)
    odd = [(9001, None), (9002, [1.0] * 7), (9003, [float("nan")] * 8), (9004, [])]
    c = c.unionByName(spark.createDataFrame(odd, c.schema))
    q = q.unionByName(spark.createDataFrame([(901, None), (902, [1.0] * 9), (903, [float("inf")] + [0.0] * 7)], q.schema))
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(c, path, cells, dim=8, space=space, file_rows=50)
    opts = SearchOptions(n_results=n, max_distance=limit, space=space)
    got = nearest_in_cells(spark, path, cells, q, opts, dim=8, **({"cell_rows": 16, "most_pairs": 0} if small else {}))
    assert found(got) == expected(chunks, questions, space, None if n == "max" else n, limit)
    assert spark.read.parquet(path).count() == len(chunks) + len(odd)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).where("cell = -1").collect()) == [*([5] if space == "cosine" else []), 9001, 9002, 9003, 9004]


def test_cells_prune_folders_and_refuse_other_spaces(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 3
    chunks = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((2000, 16))
    c, q = frames(spark, chunks, centres[:2])
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(c, path, cells, dim=16)
    opts = SearchOptions(n_results=5, max_distance=0.2)
    got = nearest_in_cells(spark, path, cells, q, opts, dim=16)
    assert found(got) == expected(chunks, centres[:2], "cosine", 5, 0.2)
    some = nearest_in_cells(spark, path, cells, q, SearchOptions("max", 0.2), dim=16)
    scans = [line for line in some._jdf.queryExecution().toString().split("\n") if "FileScan" in line and "embedding" in line]
    assert scans and all("PartitionFilters: [cell" in line for line in scans)
    read = {int(f.split("cell=")[1].split("/")[0]) for f in spark.read.parquet(path).where("chunk_id < 100").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(read) < 10 < spark.read.parquet(cells).count()
    with pytest.raises(ValueError, match="cosine"):
        nearest_in_cells(spark, path, cells, q, SearchOptions(space="l2"), dim=16)
    with pytest.raises(ValueError):
        write_cells(c, path, cells, dim=16, space="ip")
    nothing, none = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(c.where("false"), nothing, none, dim=16)
    assert found(nearest_in_cells(spark, path, cells, q.where("false"), opts, dim=16)) == []


@pytest.mark.parametrize("space", ["cosine", "l2"])
def test_nearest_centre_takes_no_angle_of_the_others(space, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.standard_normal((3000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    taken = []
    for name in ("arccos", "sqrt"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, plain=plain: (taken.append(np.size(x)), plain(x))[1])
    centres = cells_module._centres(points, 50, space)
    assert sum(taken) <= len(points) * cells_module.ROUNDS
    monkeypatch.undo()
    monkeypatch.setattr(cells_module, "CACHED_SCORES", 50 * 64)
    cell, apart = cells_module._nearest(points, centres, space)
    all_apart = cells_module._apart(points, centres, space)
    assert np.allclose(apart, all_apart.min(axis=1), atol=1e-7) and (cell == all_apart.argmin(axis=1)).all()


def test_a_large_cell_gets_several_files(spark):
    rng = np.random.default_rng(9)
    chunks, _ = frames(spark, np.vstack([rng.random((900, 4)) + [9, 0, 0, 0], rng.random((30, 4)) - [9, 0, 0, 0], np.zeros((300, 4))]), np.zeros((1, 4)))
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_cells(chunks, path, cells, dim=4, cells=2, file_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).select("cell", F.input_file_name().alias("f")).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("f").alias("f"))
    got = {r["cell"]: (r["n"], r["f"]) for r in files.collect()}
    assert got[-1][0] == 300 and sum(n for n, _ in got.values()) == 1230
    assert all(1 < f <= -(-n // 100) if n > 100 else f == 1 for n, f in got.values())


def test_recall_of_few_cells_on_the_given_vectors(spark, sf_dir):
    """Every 50th vector asks all the others: a few cells find at least 0.95 of the ten nearest."""
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/embeddings.parquet")
    chunks = rows.selectExpr("vec_id as chunk_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(chunks, path, cells, dim=64)
    n = spark.read.parquet(cells).count()
    exact = found(nearest(chunks, asked, SearchOptions(10, 2), dim=64))
    assert found(nearest_in_cells(spark, path, cells, asked, SearchOptions(10, 2), dim=64)) == exact
    recall = []
    for probes in (1, n // 2, n - 2, n):  # these vectors have no near neighbours, so hardly any cell can be left out
        near = found(nearest_in_cells(spark, path, cells, asked, SearchOptions(10, 2, approximate=probes), dim=64))
        recall.append(len(set(exact) & set(near)) / len(exact))
    assert recall == sorted(recall) and recall[2] >= 0.95 and recall[3] == 1.0


def test_few_cells_find_near_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    chunks = np.repeat(centres, 30, axis=0) + 0.3 * rng.standard_normal((1800, 32))
    c, q = frames(spark, chunks, centres)
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(c, path, cells, dim=32)
    exact = set(found(nearest(c, q, SearchOptions(10, 2), dim=32)))
    near = set(found(nearest_in_cells(spark, path, cells, q, SearchOptions(10, 2, approximate=3), dim=32)))
    assert len(exact & near) / len(exact) >= 0.95 and spark.read.parquet(cells).count() > 30


def test_lsh_recall_on_the_given_vectors(spark, sf_dir):
    """Every 50th vector and the mean of each label ask all vectors, with the default bands."""
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/embeddings.parquet")
    chunks = rows.selectExpr("vec_id as chunk_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")
    opts = SearchOptions(5, 2)
    exact = set(found(nearest(chunks, asked, opts, dim=64)))
    near = set(found(nearest_approx(chunks, asked, opts, dim=64)))
    assert len(exact & near) / len(exact) >= 0.95


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.cosine_distance(a, b), V.l2_distance(a, b), V.ip_distance(a, b), V.l2_normalize(b)).collect()
    assert [r[0] for r in got] == [1.0, 2.0, None]
    assert [r[1] for r in got] == [5.0, 16.0, 2.0]
    assert [r[2] for r in got] == [1.0, 4.0, 1.0]
    assert got[1][3] == [-1.0, 0.0]


def test_hashed_terms(spark):
    texts = spark.createDataFrame([(0, "Масло масло двигатель"), (1, "engine oil"), (2, " ... ")], "chunk_id bigint, text string")
    counts = term_counts(texts, "chunk_id")
    by_id = {r["chunk_id"]: (r["buckets"], r["tf"]) for r in counts.collect()}
    assert sorted(by_id[0][1]) == [1, 2] and by_id[1][1] == [1, 1] and by_id[2] == ([], [])
    terms = idf_table(counts)
    row = terms.first()
    assert row["n_chunks"] == 3 and len(row["idf"]) == V.HASH_DIM
    asked = hash_embed(spark.createDataFrame([(9, "масло?")], "query_id bigint, text string"), "query_id", terms.select("idf").scalar())
    both = hash_embed(texts, "chunk_id", terms.select("idf").scalar())
    hits = nearest(both, asked, SearchOptions(n_results="max", max_distance=2)).collect()
    assert min(hits, key=lambda r: r["distance"])["chunk_id"] == 0
    assert {r["chunk_id"]: r["distance"] for r in hits}[1] == 1.0 and len(hits) == 2


def _fussy_model():
    def encode(texts):
        assert len(texts) <= 2
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    return encode


def test_user_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "bad", "dddd", None])], "id bigint, text string").coalesce(1)
    got = {r["id"]: r for r in embed_texts(df, "id", _fussy_model, opts=EmbedOptions(2, True)).collect()}
    assert got[2]["embedding"] is None and "no" in got[2]["error"]
    assert np.allclose(got[3]["embedding"], [0.6, 0.8]) and got[3]["error"] is None
    assert got[4]["embedding"] == [0.0, 0.0]
