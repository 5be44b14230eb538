"""Exact top-k and embedding near-duplicates against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import cells, topk

VECTORS = "vec_id bigint, embedding array<float>, label int, rank int, rep bigint"


def odd_rows(rng, n=300, dim=8):
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # exact copies
    rows += [(n + 50 + i, (np.array(rows[3][1]) * (1 + i) + rng.normal(scale=0.02, size=dim)).tolist()) for i in range(40)]
    rows += [(1000, None), (1001, [None] + [1.0] * (dim - 1)), (1002, [math.nan] * dim), (1003, [math.inf] * dim)]
    rows += [(1050, [0.0] * dim), (1005, [1.0, 2.0]), (1006, [])]
    rows += [rows[0], (5, [100.0] * dim), (None, [1.0] * dim)]
    return [(i, v, 1, 2, 3) for i, v in rows]


def usable(rows):
    """Smallest vector per id, as the operators count them, filled up with zeros."""
    best = {}
    for i, v, *_ in rows:
        if i is not None and v is not None:
            key = [(x is not None, x if x is not None and not math.isnan(x) else math.inf) for x in v]
            if i not in best or key < best[i][0]:
                best[i] = (key, v)
    return {i: v + [0.0] * (8 - len(v)) for i, (_, v) in best.items() if all(x is not None and math.isfinite(x) for x in v)}


@pytest.mark.parametrize("group, shard, tile", [(4096, 16384, (1024, 2048)), (3, 7, (2, 3))])
def test_topk_equals_numpy(spark, group, shard, tile):
    """Also with cells so small that the merge tree has several levels."""
    rows = odd_rows(np.random.default_rng(0))
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = topk.exact_topk(df.where(F.col("vec_id") % 50 == 0), df, 5, group, shard, tile).collect()
    held = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v in usable(rows).items()}
    want = set()
    for q, x in held.items():
        if q % 50 == 0:
            best = sorted(((-int(x @ y), i) for i, y in held.items() if i != q))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_topk_of_few_and_of_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.exact_topk(few, few).orderBy("query_id").collect()] == [(0, 1, 1, 131072), (1, 1, 0, 131072)]
    assert topk.exact_topk(few.where("false"), few).collect() == []
    assert topk.exact_topk(few, few.where("false")).collect() == []


def test_products_stay_exact():
    for scale in (1.0, 2.0**20, 2.0**28, 2.0**70):
        a = np.floor(np.random.default_rng(1).normal(size=(3, 4)) * 1000) * scale
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in a] for p in a]
        assert [[int(x) for x in row] for row in topk.products(a, a)] == want


def neighbours(rows, similar=0.95):
    held = {i: np.array(v, dtype=np.float32).astype(float) for i, v in usable(rows).items() if any(v)}
    ids = sorted({r[0] for r in rows if r[0] is not None})
    top = {i: i for i in ids}
    links = {i: set() for i in ids}
    for a in held:
        for b in held:
            if a < b and held[a] @ held[b] / np.sqrt((held[a] @ held[a]) * (held[b] @ held[b])) >= similar:
                links[a].add(b), links[b].add(a)
    for _ in ids:
        before = dict(top)
        for a in ids:
            for b in links[a]:
                top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    return {i: (len(links[i]), top[i], top[i] == i) for i in ids}


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors_equal_numpy(spark, block):
    rows = odd_rows(np.random.default_rng(2))
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = cells.near_vectors(df, block_rows=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == neighbours(rows)
    assert len(got) == len({r.vec_id for r in got})


def test_recall_at_the_limit(spark):
    """Pairs of cosine 0.9502 among random directions: the hardest case for cells."""
    rng = np.random.default_rng(3)
    a = cells.unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=a.shape)
    z = cells.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([a, 0.9502 * a + math.sqrt(1 - 0.9502**2) * z])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = cells.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert found >= 0.999 * 6000


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cells.near_vectors(none).collect() == []
    zero = spark.createDataFrame([(1, [0.0], 1, 1, 1), (2, None, 1, 1, 1)], VECTORS)
    assert sorted(map(tuple, cells.near_vectors(zero).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
