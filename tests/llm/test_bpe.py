"""Ids and texts equal those of the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.llm import bpe
from tests.llm.tables import corpus, frame

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.vocabulary())


def both(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = list(own.encode(text))
    back = own.decode(np.array(got, dtype=np.int64), np.array([0, len(got)]))[0]
    return (got, back) == (want, library.decode(want, skip_special_tokens=False))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aaeethinorst'SRDM ,.!1<|>é\n ", max_size=40))
def test_any_text(library, own, text):
    assert both(library, own, text)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "<|startoftext|>a<|endoftext|>", "<|endoftext|><|endoftext|> X <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "é é", "a\x1cb \x1d",
        "I'M don'T we'LL", "a" * 3000, "ha" * 2000, "İstanbul ǅ", "日本語 한국어", "👩‍👩‍👧 x", " a",
    ],
)
def test_awkward_texts(library, own, text):
    assert both(library, own, text)


def test_bounded_cache_changes_nothing(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 2)
    small = bpe.Bpe(bpe.vocabulary())
    assert both(library, small, "some words and some more words again some words")


def test_query_on_odd_rows(spark, library, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op10_bpe(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decode_is_the_reverse(spark):
    docs = frame(spark, corpus()).selectExpr("*", "1 as ids", "2 as decoded")
    one = bpe.encode(docs, decoded=True).select("doc_id", F.sha2("_decoded", 256).alias("d"))
    two = bpe.decode(bpe.encode(docs)).select("doc_id", F.sha2("_decoded", 256).alias("d"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.encode(docs.where("false"), decoded=True).collect() == []
