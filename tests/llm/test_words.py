from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askloom.llm import words as w
from askloom.llm.frames import smallest_reachable, whole_groups
from tests.llm.tables import words

TEXTS = st.lists(st.none() | st.text(alphabet="aB é \n\t ", max_size=60), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_do_not_depend_on_pieces(texts, piece):
    column = pa.array(texts, pa.string())
    before, w.PIECE = w.PIECE, piece
    try:
        got = w.Words(column)
    finally:
        w.PIECE = before
    for i, text in enumerate(texts):
        a, b = got.bounds[i], got.bounds[i + 1]
        raw = [got.data[s:e].tobytes().decode() for s, e in zip(got.start[a:b], got.end[a:b])]
        assert raw == words(text)
    seen = {}
    for i, text in enumerate(texts):
        for word, h in zip(words(text), got.hashes[got.bounds[i] : got.bounds[i + 1]]):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_case():
    column = pa.array(["zero", "Some Words", None, "some words"]).slice(1)
    got = w.Words(column, lower=True)
    assert list(got.bounds) == [0, 2, 2, 4]
    assert list(got.hashes[:2]) == list(got.hashes[2:])


def test_shingle_sets():
    texts = ["a b c d e f a b c d e f", "a b c", "", "a b c d e"]
    values, bounds = w.sets_of(w.Words(pa.array(texts)), 5)
    assert list(np.diff(bounds)) == [6, 1, 0, 1]
    assert values[bounds[3]] in values[: bounds[1]]


def test_portions_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 900, 3, 3)]), pa.array(range(5))], ["text", "i"])
    for size in (1, 6, 1000, 10**6):
        assert [i for b in w.portions([batch], "text", size) for i in b.column("i").to_pylist()] == list(range(5))


@pytest.mark.parametrize("seed", range(5))
def test_smallest_reachable(seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    a, b = (np.array(x) for x in zip(*edges))
    assert list(smallest_reachable(n, a, b)) == label
    assert list(smallest_reachable(3, a[:0], b[:0])) == [0, 1, 2]


@pytest.mark.parametrize("cut", [1, 2, 3, 100])
def test_groups_are_not_cut(cut):
    keys = [1, 1, 1, 1, 2, 3, 3, 5, 5, 5, 5, 5, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + cut])], ["k"]) for i in range(0, len(keys), cut)]
    got = [t.column("k").to_pylist() for t in whole_groups(batches, ["k"])]
    assert sum(got, []) == keys
    assert all(not set(a) & set(b) for a, b in zip(got, got[1:]))


def thue_morse(n: int, first: str = "a") -> str:
    other = {"a": "b", "b": "a"}[first]
    return "".join(other if bin(i).count("1") % 2 else first for i in range(n))


def test_words_that_share_every_hash_modulo_powers_of_two():
    """Also: a word's hash does not depend on its place, nor on longer words around it."""
    a, b = thue_morse(4096), thue_morse(4096, "b")
    long = "y" * (w.LONG + 5)
    got = w.Words(pa.array([f"{a} {b}", a, f"x {b} {long} {a}", long])).hashes.tolist()
    assert got[0] == got[2] == got[6] and got[1] == got[4] and got[5] == got[7]
    assert len({*got}) == 4
