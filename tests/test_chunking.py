from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from askloom.functions.text import clean_elements, text_elements
from askloom.operators import chunking
from askloom.operators.chunking import chunk_documents, chunk_elements
from askloom.operators.ordering import assign_chunk_ids, exclusive_prefix
from askloom.options import ChunkOptions
from askloom.plans.jobs import chunk_texts
from tests.test_text import cut

TIGHT = ChunkOptions(max_characters=60, new_after_n_chars=50)


def pack(elements: list[tuple[str, str]], opts: ChunkOptions) -> list[str]:
    """Plain-Python reading of the packing rule."""
    out: list[str] = []
    current: str | None = None
    for category, text in elements:
        if len(text) > opts.max_characters:
            if current is not None:
                out.append(current)
            current = None
            pieces = cut(text, opts.max_characters - opts.overlap)
            out += [pieces[0]] + [pieces[i - 1][len(pieces[i - 1]) - min(opts.overlap, len(pieces[i - 1])):] + pieces[i] for i in range(1, len(pieces))]
            continue
        title = opts.by_title and category == "Title"
        if current is None:
            current = text
        elif title or len(current) > opts.soft or len(current) + 2 + len(text) > opts.max_characters:
            out.append(current)
            current = text
        else:
            current += "\n\n" + text
    if current is not None:
        out.append(current)
    return out


def random_source(rng: random.Random, n: int, uniform: bool = False) -> list[tuple[str, str]]:
    def text() -> str:
        size = 9 if uniform else rng.choice([1, 2, 5, 20, 49, 50, 51, 59, 60, 61, 150])
        return "".join(rng.choice("ab ") if 0 < i < size - 1 else "x" for i in range(size))

    return [(rng.choice(["Title"] + ["NarrativeText"] * 6), text()) for _ in range(n)]


def element_rows(spark, sources):
    rows = [(str(s), s, i, c, t) for s, els in sources.items() for i, (c, t) in enumerate(els)]
    return spark.createDataFrame(rows, "source_id string, source_ord bigint, elem_ord bigint, category string, text string")


def texts_of(chunks) -> dict[int, list[str]]:
    out: dict[int, dict[int, str]] = {}
    for r in chunks.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["chunk_ord"] not in out.setdefault(r["source_ord"], {})
        out[r["source_ord"]][r["chunk_ord"]] = r["text"]
    assert all(sorted(c) == list(range(len(c))) for c in out.values())
    return {s: [c[i] for i in range(len(c))] for s, c in out.items()}


@pytest.mark.parametrize("opts", [TIGHT, ChunkOptions("by_title", 80, 50), ChunkOptions("basic", 60, 60, 10)])
def test_in_row_and_per_row_packing_follow_the_rule(spark, opts):
    rng = random.Random(5)
    sources = {s: random_source(rng, rng.choice([1, 3, 30, 200])) for s in range(12)}
    rows = element_rows(spark, sources)
    docs = rows.groupBy("source_id", "source_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("elem_ord", "category", "text"))), lambda e: F.struct(e["category"].alias("category"), e["text"].alias("text"))).alias("elements")
    )
    want = {s: pack(els, opts) for s, els in sources.items()}
    assert texts_of(chunk_documents(docs, opts)) == want
    assert texts_of(chunk_elements(rows, opts)) == want


@pytest.mark.parametrize("uniform", [True, False])
def test_one_huge_source_is_cut_into_blocks(spark, uniform, monkeypatch):
    """A source with most of all rows, over four levels of groups of blocks, packs as if it were whole."""
    monkeypatch.setattr(chunking, "SUPER", 3)
    rng = random.Random(11)
    sources = {0: random_source(rng, 3000, uniform), 1: random_source(rng, 64, uniform), 2: random_source(rng, 7)}
    for opts in (TIGHT, ChunkOptions("by_title", 60, 50)):
        got = texts_of(chunk_elements(element_rows(spark, sources), opts, block=64))
        assert got == {s: pack(els, opts) for s, els in sources.items()}


def test_exact_lengths(spark):
    docs = spark.createDataFrame([("a", 0, "x" * 50 + "\n" + "y" * 8 + "\n" + "z"), ("b", 1, ""), ("c", 2, "q" * 61), ("d", 3, "q" * 60)], "source_id string, source_ord bigint, text string")
    got = texts_of(chunk_texts(docs, r"\n", chunk=TIGHT))
    assert got[0] == ["x" * 50 + "\n\n" + "y" * 8, "z"]
    assert 1 not in got
    assert got[2] == ["q" * 60, "q"] and got[3] == ["q" * 60]


def test_no_chunk_exceeds_the_hard_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_ord"), "text")
    for opts in (ChunkOptions(), ChunkOptions("basic", 150, 100, 30)):
        assert chunk_texts(docs, r"\n", chunk=opts).agg(F.max("n_chars")).first()[0] <= opts.max_characters


def test_ids_are_dense_in_load_order(spark):
    rng = random.Random(3)
    sizes = {s * s * 1000 + 7: rng.choice([1, 2, 9]) for s in range(300)}
    sizes[10**12] = 5000
    rows = [(s, c) for s, n in sizes.items() for c in range(n)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "source_ord bigint, chunk_ord bigint")
    got = assign_chunk_ids(chunks, block=64).orderBy("source_ord", "chunk_ord").collect()
    assert [r["chunk_id"] for r in got] == list(range(len(rows)))


def test_prefix_sum_of_clustered_orders(spark):
    values = [(10**15 - i, i % 7) for i in range(2000)] + [(-5, 3)]
    df = spark.createDataFrame(values, "o bigint, v bigint")
    total = 0
    for r in exclusive_prefix(df, "o", "v", "before").orderBy("o").collect():
        assert r["before"] == total
        total += r["v"]


def test_clean_elements_drops_empty(spark):
    df = spark.createDataFrame([("•\n...\nkept.",)], "t string")
    got = df.select(clean_elements(text_elements(F.col("t"), r"\n")).alias("e")).first()["e"]
    assert [e["text"] for e in got] == ["kept"]
