from __future__ import annotations

import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.functions import vectors
from askloom.operators import embedding, postings, search
from askloom.operators.search import nearest
from askloom.options import SearchOptions
from askloom.plans import queries
from askloom.sources import files
from tests.test_search import found

DIM = 64


def sparse(rng, rows: int) -> np.ndarray:
    """Rows with few terms, some terms in half of all rows, some in hardly any."""
    share = np.linspace(0.01, 0.5, DIM)
    hit = rng.random((rows, DIM)) < share
    hit[np.arange(rows), rng.integers(0, DIM, rows)] = True
    return hit * rng.integers(1, 4, (rows, DIM)) * np.log(1.2 / share)


def frame(spark, matrix: np.ndarray, key: str):
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, buckets array<int>, weights array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    chunks, questions = sparse(rng, 900), sparse(rng, 40)
    chunks[300:600] = chunks[300]  # a third of all rows are copies of one another
    questions[:3] = chunks[[300, 7, 8]]
    chunks[5], questions[4] = 0, 0
    return chunks, questions


def expected(chunks, questions, metric, k, limit):
    products = questions @ chunks.T
    if metric == "l2":
        d = (questions**2).sum(1)[:, None] + (chunks**2).sum(1)[None] - 2 * products
    elif metric == "ip":
        d = 1 - products
    else:
        with np.errstate(all="ignore"):
            d = 1 - products / (np.linalg.norm(questions, axis=1)[:, None] * np.linalg.norm(chunks, axis=1)[None])
    out = []
    for q in np.flatnonzero(questions.any(axis=1)):
        ranked = sorted((round(float(x), 6) + 0.0, i) for i, x in enumerate(d[q]) if chunks[i].any() and round(float(x), 6) <= limit)
        out += [(q, i, x) for x, i in (ranked[:k] if k else ranked)]
    return sorted(out)


@pytest.mark.parametrize("metric,limit", [("cosine", 0.3), ("cosine", 0.7), ("cosine", 1.5), ("l2", 40.0), ("ip", -20.0), ("ip", 0.5)])
@pytest.mark.parametrize("way", ["broadcast", "counted", "grid"])
@pytest.mark.parametrize("n", [3, "max"])
def test_sparse_search_equals_all_products(spark, data, metric, limit, way, n):
    chunks, questions = data
    opts = SearchOptions(n_results=n, max_distance=limit, space=metric)
    # the second bound is below the worst case of so many questions, but above what they take
    size = {"broadcast": {}, "counted": dict(broadcast_bytes=39 * 16 * DIM), "grid": dict(broadcast_bytes=99, cell_rows=6)}[way]
    got = found(nearest(frame(spark, chunks, "chunk_id"), frame(spark, questions, "query_id"), opts, dim=DIM, **size))
    want = expected(chunks, questions, metric, opts.k, limit)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_questions_are_copied_by_their_bytes(spark, data):
    """Many short questions need one pass over the chunks and no shuffle but that of the ranks."""
    chunks, questions = data
    c, q = frame(spark, chunks, "chunk_id"), frame(spark, questions, "query_id")
    plan = nearest(c, q, SearchOptions(n_results="max"), dim=DIM, broadcast_bytes=39 * 16 * DIM)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    plan = nearest(c, q, SearchOptions(n_results="max"), dim=DIM, broadcast_bytes=99)._jdf.queryExecution().toString()
    assert "CoGroup" in plan


def test_lists_of_common_terms_are_not_read(data):
    """With a limit, entries read are fewer than those of all lists; nothing near is lost."""
    chunks, questions = data
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(chunks) if v.any()]
    table = pa.table({"id": [r[0] for r in rows], "terms": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "weights": [r[2] for r in rows]})
    read = []

    class Counted(postings.Block):
        def _add(self, sums, q, begin, end):
            read.append(sum(self.first[t + 1] - self.first[t] for t in q.terms[begin:end]))
            super()._add(sums, q, begin, end)

    block = Counted(postings.Vectors(table), "cosine", DIM)
    unit = chunks[block.ids] / block.lengths[:, None]
    whole = 0
    for v in questions[questions.any(axis=1)]:
        terms = np.flatnonzero(v)
        whole += sum(block.first[t + 1] - block.first[t] for t in terms)
        got, d = block.near(postings.Question(terms.astype(np.int32), v[terms], True), 0.2, None)
        cosine = unit @ (v / np.linalg.norm(v))
        assert got.tolist() == np.flatnonzero(np.round(1 - cosine, 6) <= 0.2).tolist()
    assert sum(read) < 0.6 * whole


def test_batches_become_blocks(monkeypatch, data):
    monkeypatch.setattr(postings, "BLOCK_ROWS", 10)
    batch = pa.record_batch({"id": list(range(25)), "t": pa.array([[1, 3]] * 25, pa.list_(pa.int32())), "w": [[1.0, 2.0]] * 25})
    blocks = list(postings.blocks_of([batch, batch.slice(20, 5), batch.slice(0, 0)], "ip", 4))
    assert [len(b.ids) for b in blocks] == [10, 10, 10] and blocks[-1].ids.tolist() == [*range(20, 25), *range(20, 25)]
    assert all(b.lengths[0] == pytest.approx(5**0.5) for b in blocks)


def test_one_block_is_held_at_a_time(monkeypatch):
    live, most = weakref.WeakSet(), []

    class Seen(postings.Block):
        def __init__(self, *args):
            most.append(len(live))
            live.add(self)
            super().__init__(*args)

    monkeypatch.setattr(postings, "Block", Seen)
    monkeypatch.setattr(postings, "BLOCK_ROWS", 2)
    lists = [pa.array([[1]] * 5, pa.list_(pa.int32())), pa.array([[1.0]] * 5, pa.list_(pa.float64()))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), *lists], names=["chunk_id", "buckets", "weights"])
    asked = search._prepared(pa.Table.from_batches([batch.slice(0, 1)]), "cosine", 4)[1]
    found = list(search._score_sparse(iter([batch]), *asked, 5, 1.0, "cosine", 4))
    assert sum(f.num_rows for f in found) == 5
    assert most == [0, 0, 0]


def test_counts_of_rows_cut_into_several_sorts(spark, monkeypatch):
    rows = [(k, " ".join(f"w{i % 5}" for i in range(n))) for k, n in enumerate((0, 3, 40, 1, 7, 0))] + [(6, None)]
    texts = spark.createDataFrame(rows, "k bigint, text string").coalesce(1)
    whole = embedding.term_counts(texts, "k").orderBy("k").collect()
    monkeypatch.setattr(vectors, "COUNT_TOKENS", 4)
    assert embedding.term_counts(texts, "k").orderBy("k").collect() == whole
    assert [sum(r["tf"] or []) for r in whole] == [0, 3, 40, 1, 7, 0, 0]


def test_office_files_are_made_one_at_a_time():
    lines = pa.array([["a"], ["b", "c"], []], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(["0.docx", "1.pptx", "2.xlsx"]), lines], names=["source_id", "lines"])
    made = list(queries._office_files(iter([batch])))
    assert [m.num_rows for m in made] == [1, 1, 1]
    assert [t for m in made for _, _, _, t, _ in files._read_office(*m.to_pylist()[0].values())] == ["a", "b", "c"]


def test_buckets_of_tokens_are_those_of_the_formula(spark):
    texts = spark.createDataFrame([(0, "Öl, oil OIL 7"), (1, ""), (2, None), (3, "a b a " * 50)], "k bigint, text string")
    words = vectors.tokens(F.col("text"))
    rows = texts.select("k", vectors.count_buckets(100)(words).alias("c"), F.transform(words, lambda w: vectors.token_bucket(w, 100)).alias("b"))
    for r in rows.collect():
        want = sorted(Counter(r["b"] or []).items())
        assert (r["c"]["buckets"], r["c"]["tf"]) == ([b for b, _ in want], [n for _, n in want])


def test_words_are_hashed_like_tokens(spark):
    """All at once, without a value of Arrow for each word; tokens have no empty ones at the ends."""
    words = ["", "a", "é", "я" * 40, "x" * 200, "12", "straße"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(vectors.token_bucket(F.col("w"), 1000).alias("b")).collect()
    assert vectors.word_buckets(pa.array([w.encode() for w in words], pa.binary()), 1000).tolist() == [r["b"] for r in rows]
    assert vectors.word_buckets(pa.array([], pa.binary())).tolist() == []
    texts = spark.createDataFrame([("..One, zwei 3!",), (" -",), ("",), (None,)], "t string")
    assert [r["w"] for r in texts.select(vectors.tokens(F.col("t")).alias("w")).collect()] == [["one", "zwei", "3"], [], [], None]
