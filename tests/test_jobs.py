from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.functions.text import text_elements
from askloom.operators import ordering
from askloom.operators.embedding import Embedder
from askloom.options import SearchOptions
from askloom.plans import jobs
from askloom.plans.queries import QUERIES, in_ranges, numbered_over_files
from askloom.session import new_table_path
from askloom.sources import collections, files
from askloom.streaming.ingest import ingest_stream, latest_versions, prompt_stream, search_ingested
from askloom.streaming.turns import latest_user_turns

MANUAL = [
    ("a", 0, "Общие сведения о технике безопасности\nНе курите рядом с топливом"),
    ("b", 1, "Какое масло заливать: в двигатель заливать масло 10W-30\nОбъем масла 1,1 литра"),
    ("c", 2, "Гарантия на изделие составляет один год"),
    ("empty", 3, "  \n "),
]
QUESTION = "Какое масло заливать в двигатель и сколько?"


def docs(spark, rows=MANUAL):
    raw = spark.createDataFrame(rows, "source_id string, source_ord bigint, text string")
    return jobs.elements_in_rows(raw, text_elements(F.col("text"), r"\n"))


@pytest.fixture(scope="module")
def built(spark):
    root = new_table_path(spark, "collections")
    chunks, log = jobs.build_collection(spark, root, "123", docs(spark))
    return root, chunks, log


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_question_about_engine_oil(spark, built):
    root, chunks, log = built
    assert chunks.count() == 3 and [r["chunk_id"] for r in chunks.orderBy("chunk_id").collect()] == [0, 1, 2]
    assert {r["source_id"]: r["status"] for r in log.collect()} == {"a": "loaded", "b": "loaded", "c": "loaded", "empty": "no_text"}
    row = jobs.rag_prompts(spark, root, "123", ask(spark, QUESTION), SearchOptions(max_distance=0.8)).first()
    assert row["status"] == "answered" and "масло" in row["prompt"] and len(row["prompt"]) > len(QUESTION)
    assert row["context"].startswith("Какое масло")


def test_all_max_blank_and_no_context(spark, built):
    root, *_ = built
    asked = ask(spark, QUESTION, " \t", "unrelated words")
    every = {r["query_id"]: r for r in jobs.rag_prompts(spark, root, "123", asked, SearchOptions("all")).collect()}
    assert every[0]["n_hits"] == 3 and every[2]["status"] == "answered" and every[1]["status"] == "blank"
    assert every[0]["context"].index("безопасности") < every[0]["context"].index("Гарантия")
    some = {r["query_id"]: r for r in jobs.rag_prompts(spark, root, "123", asked, SearchOptions("max", 0.99)).collect()}
    assert some[2]["status"] == "no_context" and some[2]["prompt"] is None and some[0]["n_hits"] >= 1


def _lengths_model():
    def encode(texts):
        if any("курите" in t for t in texts):
            raise RuntimeError("refused")
        return [[float("масло" in t), float("Гарантия" in t), 0.1] for t in texts]

    return encode


def test_collection_of_a_user_model(spark):
    """Dense vectors from a supplied model; a text it fails on is stored and never found."""
    root, model = new_table_path(spark, "collections"), Embedder("flags", _lengths_model)
    chunks, log = jobs.build_collection(spark, root, "m", docs(spark), embedder=model)
    assert chunks.count() == 3
    assert sorted((r.status, r.detail) for r in log.collect()) == [("error", "1 chunks without a vector"), ("loaded", None), ("loaded", None), ("no_text", None)]
    got = jobs.rag_prompts(spark, root, "m", ask(spark, "масло", "Гарантия"), SearchOptions(1, 0.2), embedder=model)
    contexts = {r["query_id"]: r["context"] for r in got.collect()}
    assert contexts[0].startswith("Какое масло") and contexts[1].startswith("Гарантия")
    every = collections.search_collection(spark, root, "m", ask(spark, "масло"), SearchOptions("max", 2), model)
    assert sorted(r["chunk_id"] for r in every.collect()) == [1, 2]
    with pytest.raises(ValueError, match="embedded with"):
        jobs.rag_prompts(spark, root, "m", ask(spark, "масло"))


def test_collection_with_an_index(spark):
    """Searched by cell, exact unless few cells are asked for; other distances and replaced collections go without."""
    root, model = new_table_path(spark, "collections"), Embedder("flags", _lengths_model)
    asked = ask(spark, "масло", "Гарантия", "курите")
    jobs.build_collection(spark, root, "plain", docs(spark), embedder=model)
    with pytest.raises(ValueError, match="no index"):
        collections.search_collection(spark, root, "plain", asked, SearchOptions(approximate=1), model)
    for _ in range(2):
        _, log = jobs.build_collection(spark, root, "m", docs(spark), embedder=model, index="cosine")
    assert sorted(r.status for r in log.collect()) == ["error", "loaded", "loaded", "no_text"]
    assert collections.index_space(spark, root, "m") == "cosine"
    failed = collections.chunks_without_vector(spark, root, "m")
    assert failed.count() == 1 and {f.split("/")[-2] for f in failed.inputFiles() if "/vectors/" in f} == {"cell=-1"}
    for opts in (SearchOptions(1, 0.2), SearchOptions("max", 2), SearchOptions(2, 3, space="l2")):
        rows = [sorted(map(tuple, collections.search_collection(spark, root, n, asked, opts, model).collect())) for n in ("plain", "m")]
        assert rows[0] == rows[1] != []
    near = collections.search_collection(spark, root, "m", asked, SearchOptions(1, 2, approximate=1), model)
    assert {r["query_id"] for r in near.collect()} == {0, 1}
    jobs.build_collection(spark, root, "m", docs(spark), embedder=model)
    assert collections.index_space(spark, root, "m") is None
    with pytest.raises(ValueError, match="dense"):
        collections.create_collection(spark, root, "x", jobs.chunk_documents(docs(spark)), index="cosine")


def test_only_segments_of_hits_are_read(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SEGMENT_ROWS", 2)
    root = new_table_path(spark, "collections")
    jobs.build_collection(spark, root, "seg", docs(spark))
    found = jobs.rag_prompts(spark, root, "seg", ask(spark, QUESTION), SearchOptions(1, 0.8))
    assert [r["n_hits"] for r in found.collect()] == [1]
    assert "dynamicpruningexpression(segment" in found._jdf.queryExecution().executedPlan().toString()


def test_contexts_beyond_one_string_stop_no_other_question(spark, built, monkeypatch):
    root, *_ = built
    monkeypatch.setattr(jobs, "CONTEXT_CHARS", 80)
    asked = ask(spark, "безопасности масло Гарантия двигатель", "Гарантия", " ")
    got = {r["query_id"]: (r["status"], r["prompt"] is None) for r in jobs.rag_prompts(spark, root, "123", asked, SearchOptions("max", 0.99)).collect()}
    assert got == {0: ("too_large", True), 1: ("answered", False), 2: ("blank", True)}
    got = {r["query_id"]: r["status"] for r in jobs.rag_prompts(spark, root, "123", asked, SearchOptions("all")).collect()}
    assert got == {0: "too_large", 1: "too_large", 2: "blank"}


def _odd_model():
    """Vectors of two numbers, of three where the text speaks of fuel; refuses questions about weather."""

    def encode(texts):
        if any("weather" in t for t in texts):
            raise RuntimeError("refused")
        return [[1.0, float("масло" in t), 0.5][: 3 if "топливом" in t else 2] for t in texts]

    return encode


def test_odd_sized_vectors_and_refused_questions(spark):
    """One vector of another size loses its own chunk only, and a question without a vector is an error."""
    root, model = new_table_path(spark, "collections"), Embedder("odd", _odd_model)
    _, log = jobs.build_collection(spark, root, "o", docs(spark), embedder=model)
    got = {r["source_id"]: (r["status"], r["detail"]) for r in log.collect()}
    assert got["a"] == ("error", "1 chunks without a vector") and got["b"][0] == got["c"][0] == "loaded"
    assert [r["error"] for r in collections.chunks_without_vector(spark, root, "o").collect()] == ["vector of 3 numbers, not 2"]
    asked = ask(spark, "масло", "weather", "топливом", " ")
    found = jobs.rag_prompts(spark, root, "o", asked, SearchOptions(1, 0.1), embedder=model).collect()
    assert {r["query_id"]: r["status"] for r in found} == {0: "answered", 1: "error", 2: "error", 3: "blank"}


def test_sources_that_arrive_again(spark, tmp_path):
    """Empty again: nothing is left. Twice in one batch: one of them, whole."""
    place, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "source_id string, source_ord bigint, version int, text string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(place)
        ingest_stream(spark.readStream.schema(schema).parquet(place), text_elements(F.col("text"), r"\n"), out, checkpoint).awaitTermination()
        return sorted((r["source_id"], r["chunk_ord"], r["text"]) for r in latest_versions(spark, out).collect())

    first = arrive(("a", 0, 1, "old a"), ("b", 1, 1, "first b"), ("b", 1, 2, "second b"), ("c", 2, 1, "same"), ("c", 2, 1, "same"))
    assert first == [("a", 0, "old a"), ("b", 0, "second b"), ("c", 0, "same")]
    assert arrive(("a", 0, 2, "  "), ("d", 3, 1, "new d")) == [("b", 0, "second b"), ("c", 0, "same"), ("d", 0, "new d")]


@pytest.mark.parametrize("parts", [1, 2, 7, 40, 200])
def test_layout_gives_the_same_ids(spark, parts):
    """One hot source, single chunks, gaps between orders, more parts than chunks."""
    sizes = {-5: 1, 3: 90, 4: 1, 10: 2, 1000: 1, 2000: 30}
    rows = [(s, c, f"{s}-{c}") for s, n in sizes.items() for c in range(n)]
    chunks = spark.createDataFrame(rows, "source_ord bigint, chunk_ord bigint, text string").repartition(5)
    got = ordering.dense_layout(chunks, len(rows), parts).select("source_ord", "chunk_ord", "text", "chunk_id").collect()
    assert sorted(map(tuple, got)) == sorted((*r, i) for i, r in enumerate(sorted(rows)))


def test_failed_replacement_leaves_the_old_version(spark, monkeypatch):
    root = new_table_path(spark, "collections")
    old, new = jobs.chunk_documents(docs(spark)), jobs.chunk_documents(docs(spark, MANUAL[:1]))
    collections.create_collection(spark, root, "v", old)
    with monkeypatch.context() as broken:
        broken.setattr(collections, "idf_table", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            collections.create_collection(spark, root, "v", new)
    reading = collections.collection_chunks(spark, root, "v")
    assert reading.count() == 3 and collections.current_version(spark, root, "v") == 1
    collections.create_collection(spark, root, "v", new)
    assert collections.current_version(spark, root, "v") == 3 and collections.collection_chunks(spark, root, "v").count() == 1
    assert reading.count() == 3  # begun before the switch
    collections.create_collection(spark, root, "v", old)
    left = {v for t in collections.TABLES for v in collections._versions(spark, root, t, "v")}
    assert left == {3, 4} and collections.collection_count(spark, root, "v").first()["n_chunks"] == 3
    collections.delete_collection(spark, root, "v")
    assert not collections.collection_exists(spark, root, "v") and collections.stored_names(spark, root).count() == 0


def test_collections_replace_drop_and_guard(spark, built):
    root = new_table_path(spark, "collections")
    collections.create_collection(spark, root, "one", jobs.chunk_documents(docs(spark)))
    collections.create_collection(spark, root, "007", jobs.chunk_documents(docs(spark, MANUAL[:1])))
    assert collections.collection_count(spark, root, "one").first()["n_chunks"] == 3
    collections.create_collection(spark, root, "one", jobs.chunk_documents(docs(spark, MANUAL[1:2])))
    assert [r["source_id"] for r in collections.collection_chunks(spark, root, "one").collect()] == ["b"]
    assert collections.collection_chunks(spark, root, "007").first()["collection"] == "007"
    collections.delete_collection(spark, root, "one")
    collections.delete_collection(spark, root, "one")
    assert not collections.collection_exists(spark, root, "one") and collections.collection_exists(spark, root, "007")
    for call in (
        lambda: collections.collection_chunks(spark, root, "one"),
        lambda: collections.create_collection(spark, root, "../x", jobs.chunk_documents(docs(spark))),
        lambda: collections.create_collection(spark, root, "none", jobs.chunk_documents(docs(spark, MANUAL[3:]))),
        lambda: collections.collection_terms(spark, root, "007", Embedder("other-model")),
        lambda: jobs.build_collection(spark, root, "x", docs(spark), embedder=None),
        lambda: jobs.rag_prompts(spark, root, "007", ask(spark, "q"), template="{context}"),
    ):
        with pytest.raises(ValueError):
            call()


def test_verbatim_passages_are_found(spark):
    """A passage that lies whole in a chunk is mostly retrieved; too few do so in smaller tables."""
    sf_dir = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_ord"), "text")
    root = new_table_path(spark, "collections")
    chunks, _ = jobs.build_collection(spark, root, "d", jobs.elements_in_rows(raw, text_elements(F.col("text"), r"\n")))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")

    def squeezed(c):
        return F.regexp_replace(F.col(c), r"\s+", " ")

    texts = [(r["query_id"], r["t"]) for r in asked.select("query_id", F.rtrim(squeezed("text"), F.lit(".,:;")).alias("t")).collect()]
    stored = [r["t"] for r in chunks.select(squeezed("text").alias("t")).collect()]
    whole = {q for q, t in texts if any(t in s for s in stored)}
    hits = {r["query_id"] for r in collections.search_collection(spark, root, "d", asked).collect()}
    assert len(whole) >= 5 and len(whole & hits) >= 0.6 * len(whole)


def _write(path, name, rows):
    """Files are read oldest first, so each is dated by its name."""
    (path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    os.utime(path / name, (1_700_000_000 + int(name[0]),) * 2)


def test_streaming_ingest_equals_batch_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    fields = ("source_id", "source_ord", "text")

    def run():
        stream = spark.readStream.schema("source_id string, source_ord bigint, text string").option("maxFilesPerTrigger", 1).json(str(source))
        ingest_stream(stream, text_elements(F.col("text"), r"\n"), out, checkpoint).awaitTermination()
        rows = spark.read.parquet(out).select("source_ord", "chunk_ord", "text").collect()
        return sorted(map(tuple, rows))

    def batch(rows):
        return sorted((r["source_ord"], r["chunk_ord"], r["text"]) for r in jobs.chunk_documents(docs(spark, rows)).collect())

    _write(source, "1.json", [dict(zip(fields, r)) for r in MANUAL[:1]])
    _write(source, "2.json", [dict(zip(fields, r)) for r in MANUAL[1:2]])
    assert run() == batch(MANUAL[:2])
    _write(source, "3.json", [dict(zip(fields, r)) for r in MANUAL[2:]])
    assert run() == batch(MANUAL)
    best = search_ingested(spark, out, ask(spark, QUESTION), SearchOptions(1, 0.8)).first()
    assert best["source_id"] == "b" and best["rank"] == 1
    # a source with numbers of any size, and one that arrives again with another text
    far = {"source_id": "far", "source_ord": 1 << 60, "text": "Совсем другое"}
    _write(source, "4.json", [far])
    run()
    _write(source, "5.json", [far | {"text": QUESTION}])
    run()
    hits = search_ingested(spark, out, ask(spark, QUESTION), SearchOptions(9, 2)).collect()
    assert [r["text"] for r in hits if r["source_id"] == "far"] == [QUESTION]


def test_streaming_prompts_equal_batch(spark, built, tmp_path):
    root, *_ = built
    source = tmp_path / "in"
    source.mkdir()
    _write(source, "1.json", [{"query_id": 0, "text": QUESTION}])
    _write(source, "2.json", [{"query_id": 1, "text": "Гарантия на изделие"}])
    stream = spark.readStream.schema("query_id bigint, text string").option("maxFilesPerTrigger", 1).json(str(source))
    opts = SearchOptions(max_distance=0.8)
    prompt_stream(spark, stream, root, "123", str(tmp_path / "out"), str(tmp_path / "cp"), opts).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id").orderBy("query_id").collect()
    assert got == jobs.rag_prompts(spark, root, "123", ask(spark, QUESTION, "Гарантия на изделие"), opts).orderBy("query_id").collect()


def test_latest_user_turn_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [[(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x")], [(1, 2, "user", "c"), (1, 3, "user", "d"), (2, 1, "assistant", "y")]]
    for i, batch in enumerate(rows):
        _write(source, f"{i}.json", [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in batch])
    seen = []
    stream = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").option("maxFilesPerTrigger", 1).json(str(source))
    writer = latest_user_turns(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    writer.foreachBatch(lambda df, i: seen.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start().awaitTermination()
    assert [b for b in seen if b] == [[(1, 0, "a"), (2, 0, "x")], [(1, 3, "d")]]


def test_all_names_are_looked_up_at_once(spark, tmp_path):
    root = str(tmp_path / "many")
    names = spark.createDataFrame([("007",), ("7",), ("a b",), ("é",), (None,), ("007",)], "name string")
    found = lambda: Counter(map(tuple, collections.collections_exist(spark, root, names).collect()))
    assert found() == Counter([("007", False)] * 2 + [("7", False), ("a b", False), ("é", False), (None, False)])
    for name in ("007", "a b", "é", "8"):
        collections.create_collection(spark, root, name, jobs.chunk_documents(docs(spark)))
    collections.delete_collection(spark, root, "a b")
    assert found() == Counter([("007", True)] * 2 + [("7", False), ("a b", False), ("é", True), (None, False)])


def test_tables_are_written_to_many_files_and_numbered_through(spark, tmp_path):
    rows = spark.range(500).selectExpr("499 - id as id", "'x' as text").repartition(3)
    in_ranges(rows, "id").write.csv(str(tmp_path / "t"))
    found = files.csv_elements(spark, str(tmp_path / "t"))
    assert found.select("source_id").distinct().count() > 1
    got = numbered_over_files(found, F.lit("")).select("elem_ord", "text").collect()
    assert sorted(map(tuple, got)) == [(k, f"{k} x") for k in range(500)]


@pytest.mark.parametrize("folder", [True, False])
def test_tables_of_one_or_many_files_stream_alike(spark, tmp_path, folder):
    long = " ".join(["oil"] * 30)
    docs_ = spark.createDataFrame([(k, f"{long} {k}\n{long}") for k in range(6)], "doc_id bigint, text string")
    turns = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(3) for t in range(2)], "conv_id bigint, turn bigint, role string, text string")
    asked = spark.createDataFrame([(0, long)], "item_id bigint, text string")
    for name, df in {"documents": docs_, "conversations": turns, "benchmark": asked}.items():
        if folder:
            df.repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    stored = QUERIES["stream_ingest"](spark, str(tmp_path)).collect()
    assert sorted((r["source_ord"], r["chunk_ord"]) for r in stored) == [(k, 0) for k in range(6)]
    assert [r["rank"] for r in QUERIES["stream_search"](spark, str(tmp_path)).orderBy("rank").collect()] == [1, 2, 3]
    latest = QUERIES["stream_latest_turn"](spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in latest) == [(c, 1, f"{c} 1") for c in range(3)]
