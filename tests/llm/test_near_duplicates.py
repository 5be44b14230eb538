from __future__ import annotations

import random
from collections import Counter

import pytest

from askloom.llm import near_duplicates as nd
from askloom.llm.components import components
from tests.llm.tables import corpus, frame, words


def expected(rows):
    """Brute force over all pairs."""
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            w = words(text, lower=True)
            sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {d: d for d in sets}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    for _ in range(len(top)):
        before = dict(top)
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
        if before == top:
            break
    return {d: (len(s), top[d], top[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("leaf, block", [(64, 512), (2, 5)])
def test_equals_brute_force(spark, monkeypatch, leaf, block):
    """Also with leaves so small that nodes branch, and blocks so small that families need many."""
    monkeypatch.setattr(nd, "BLOCK_ROWS", block)
    rows = corpus()
    docs = frame(spark, rows).selectExpr("*", "1 as node", "2 as component", "'x' as signature")
    got = nd.near_duplicates(docs, leaf=leaf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows if r[0] is not None})


def test_empty_table(spark):
    assert nd.near_duplicates(frame(spark, [])).collect() == []


def test_filter_keeps_one_of_each_group_and_rows_without_id(spark):
    rows = corpus()
    kept = nd.keep_representatives(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = Counter(r[0] for r in rows if r[0] is None or expected(rows)[r[0]][2])
    assert Counter(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(7, i) for i in range(100)] + [(300, 301), (5, 5), (None, 3)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[kind]
    top = {}
    for a, b in edges:
        if a is not None:
            top.setdefault(a, a), top.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                top[a] = top[b] = min(top[a], top[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: t for n, t in top.items() if n != t}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_words_of_equal_polynomials_are_no_copies(spark):
    from tests.llm.test_words import thue_morse

    rows = [(1, thue_morse(1024), None, None, None), (2, thue_morse(1024, "b"), None, None, None)]
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_representatives_under_clashing_names(spark):
    docs = frame(spark, [(1, "a b c d e f", None, None, None), (2, "a b c d e f", None, None, None), (None, None, None, None, None)])
    kept = nd.keep_representatives(docs.selectExpr("*", "7 as _gone", "8 as component_id"))
    assert sorted((r.doc_id or 0, r._gone, r.component_id) for r in kept.collect()) == [(0, 7, 8), (1, 7, 8)]
    assert kept.columns == [*docs.columns, "_gone", "component_id"]
