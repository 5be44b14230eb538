from __future__ import annotations

import hashlib

import pytest

from askloom.llm import substring_dedup as sd
from tests.llm.tables import corpus, frame, words


def expected(rows, window):
    first = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, gram", [(50, 12), (5, 2), (3, 3)])
def test_equals_brute_force(spark, window, gram):
    rows = corpus()
    docs = frame(spark, rows).selectExpr("*", "1 as tag", "2 as anchors", "3 as spans", "4 as copied")
    got = sd.removals(docs, window, gram).collect()
    assert sorted([(r.doc_id, r._n_words, r._n_removed, r._kept) for r in got], key=str) == expected(rows, window)


def test_maximal_intervals(spark):
    base = [f"a{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base[10:90], "y", *base[95:150], "z"]))]
    docs = frame(spark, rows, "doc_id bigint, text string")
    spans = {r.doc_id: r._spans for r in sd.removals(docs).collect()}
    import numpy as np

    assert np.frombuffer(spans[2], np.int32).tolist() == [1, 81, 82, 137]
    assert not spans[1]


def test_stage_changes_only_what_loses_words(spark):
    rows = corpus()
    before = {r[0]: r[1] for r in rows}
    stage = sd.drop_repeated_passages(frame(spark, rows))
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {d: (n, t) for d, _, n, t in expected(rows, 50)}
    for r in stage.collect():
        lost, text = want[r.doc_id]
        assert r.text == (text if lost else before[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_empty_table(spark):
    assert sd.removals(frame(spark, [])).collect() == []


def test_digest_of_nothing(spark):
    rows = frame(spark, [(1, None)], "doc_id bigint, text string")
    assert sd.removals(rows).first()._kept == ""
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_words_of_equal_polynomials_stay(spark):
    from tests.llm.test_words import thue_morse

    base = " ".join(f"a{i}" for i in range(49))
    rows = [(1, f"{base} {thue_morse(1024)}", None, None, None), (2, f"{base} {thue_morse(1024, 'b')}", None, None, None)]
    a, b = " ".join(thue_morse(4096)), " ".join(thue_morse(4096, "b"))
    got = {r.doc_id: r._n_removed for r in sd.removals(frame(spark, [*rows, (3, a, None, None, None), (4, b, None, None, None)])).collect()}
    assert got[2] == 0
    # every window of 50 of the second sequence stands in the first, but the two texts are not one
    assert got[3] == 0 and got[4] == expected([(3, a), (4, b)], 50)[1][2]
