from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from askloom.operators import folding, postings, search
from tests.test_postings import DIM, expected, sparse


def batch(matrix: np.ndarray) -> pa.RecordBatch:
    ids = np.flatnonzero(matrix.any(axis=1))
    terms = pa.array([np.flatnonzero(v).tolist() for v in matrix[ids]], pa.list_(pa.int32()))
    weights = pa.array([v[v != 0].tolist() for v in matrix[ids]], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(ids), terms, weights], names=["chunk_id", "buckets", "weights"])


def scored(chunks: np.ndarray, questions: np.ndarray, metric: str, k: int | None, limit: float | None, dim: int = DIM) -> list[tuple]:
    score, asked = search._prepared(pa.Table.from_batches([batch(questions)]), metric, dim)
    parts = score(iter([batch(chunks)]), *asked, k, limit, metric, dim)
    return sorted((r["query_id"], r["chunk_id"], r["distance"]) for part in parts for r in part.to_pylist())


@pytest.fixture
def small(monkeypatch):
    """Everything that is cut into parts is cut, and terms share groups."""
    sizes = dict(GROUPS=12, TILE_ROWS=30, TILE_QUESTIONS=8, FOLDED=20, ENTRIES=50, PAIRS=10)
    for name, value in sizes.items():
        monkeypatch.setattr(folding, name, value)
    monkeypatch.setattr(postings, "BLOCK_ROWS", 200)
    monkeypatch.setattr(search, "HIT_ROWS", 25)


@pytest.mark.parametrize("metric,limit", [("cosine", 0.2), ("cosine", 0.5), ("cosine", 1.0), ("ip", -20.0), ("ip", 0.5), ("l2", 40.0)])
@pytest.mark.parametrize("k", [3, None])
def test_folded_search_equals_all_products(small, metric, limit, k):
    rng = np.random.default_rng(7)
    chunks, questions = sparse(rng, 430), sparse(rng, 45)
    chunks[50:130] = chunks[50]  # crowds some tiles, of which its questions read lists
    questions[[3, 9, 30]] = chunks[[50, 7, 401]]
    chunks[5], questions[4] = 0, 0
    chunks[::9] *= -1
    questions[40] *= -1
    got = scored(chunks, questions, metric, k, limit)
    want = expected(chunks, questions, metric, k, limit)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_few_pairs_are_multiplied_out(monkeypatch):
    """No list is read for a question that is near few rows, and few other rows are left by folding."""
    rng = np.random.default_rng(3)
    chunks, questions = ((rng.random((n, 1024)) < 0.03) * rng.integers(1, 6, (n, 1024)).astype(float) for n in (3000, 200))
    questions[:20] = chunks[:20]
    read, multiplied = [], []

    class Counted(postings.Block):
        def _add(self, sums, q, begin, end):
            read.append(sum(self.first[t + 1] - self.first[t] for t in q.terms[begin:end]))
            super()._add(sums, q, begin, end)

    true_product = folding._multiplied

    def counted(rows, at, *more):
        multiplied.append(len(at))
        return true_product(rows, at, *more)

    monkeypatch.setattr(postings, "Block", Counted)
    monkeypatch.setattr(folding, "_multiplied", counted)
    got = scored(chunks, questions, "cosine", 2, 0.6, 1024)
    assert [g[:2] for g in got] == [w[:2] for w in expected(chunks, questions, "cosine", 2, 0.6)]
    assert not read and sum(multiplied) < 0.01 * len(chunks) * len(questions)
