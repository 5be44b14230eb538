"""Files, pages and subtitles to one collection; questions of conversations to answers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from askloom.operators.embedding import Embedder
from askloom.operators.ordering import number_within
from askloom.options import ChatOptions, ChunkOptions, SearchOptions
from askloom.plans import chat, ingest, jobs
from askloom.plans.queries import _office_bytes
from askloom.session import new_table_path
from askloom.sources import collections

FILES = {
    "a.TXT": "\ufeffone\n\n- two.\n\n \n", "deep/b c+d.md": "# Head\nbody", "o.org": "** Top\nline", "p.html": "<h1>H&amp;M</h1><p>x",
    "t.csv": 'k,"v, w"\n\n2,y\n', "u.tsv": "1\tz\n", "empty.txt": " \n ", "skip.pdf": "%PDF", "bad.docx": "not a zip", "not listed.txt": "hidden",
}
URLS = [
    "http://s/1", "http://s/none", "https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://www.youtube.com/watch?v=short",
    "https://www.youtube.com/live/zzzzzzzzzzz", "http://s/1",
]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("up loads")
    for name, text in FILES.items():
        os.makedirs((folder / name).parent, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "w.DOCX").write_bytes(_office_bytes("docx", ["para 1", "para 2"]))
    (folder / "s.pptx").write_bytes(_office_bytes("pptx", ["slide"]))
    (folder / "x.xlsx").write_bytes(_office_bytes("xlsx", ["cell"]))
    (folder / "odd.txt").write_bytes(b"caf\xe9 ok")
    names = [n for n in FILES if n != "not listed.txt"] + ["w.DOCX", "s.pptx", "x.xlsx", "odd.txt", "gone.md", "a.TXT"]
    lines = [("abcdefghijk", "de", g, s, f"{'auto' if g else 'hand'} {s}") for g in (True, False) for s in (7, 2, 9)]
    return ingest.Sources(
        str(folder),
        spark.createDataFrame([(n, 3 * i) for i, n in enumerate(names)], "uri string, source_ord bigint"),
        spark.createDataFrame(list(zip(URLS, range(10, 99))), "url string, source_ord bigint"),
        spark.createDataFrame([("http://s/1", "<p>page text")], "url string, html string"),
        spark.createDataFrame(lines, "video_id string, lang string, is_generated boolean, seq bigint, text string"),
        "de",
    )


def test_every_source_by_its_type(spark, sources):
    root = new_table_path(spark, "collections")
    chunks, log = ingest.ingest_sources(spark, root, "all", sources)
    uris = {r["source_id"]: r["uri"] for r in log.collect()}
    stored = chunks.orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in stored] == list(range(len(stored)))
    assert [(uris[r["source_id"]], r["text"]) for r in stored] == [
        ("a.TXT", "one\n\n- two"), ("deep/b c+d.md", "Head\n\nbody"), ("o.org", "Top\n\nline"), ("p.html", "H&M\n\nx"), ("t.csv", "k v, w\n\n2 y"),
        ("u.tsv", "1 z"), ("w.DOCX", "para 1\n\npara 2"), ("s.pptx", "slide"), ("x.xlsx", "cell"), ("odd.txt", "caf\ufffd ok"), ("a.TXT", "one\n\n- two"),
        ("http://s/1", "page text"), (URLS[2], "hand 2\n\nhand 7\n\nhand 9"), ("http://s/1", "page text"),
    ]
    got = sorted((r["uri"], r["status"], r["detail"], r["n_chunks"]) for r in log.collect() if r["status"] != "loaded")
    assert [(u, s) for u, s, *_ in got] == sorted([
        ("bad.docx", "error"), ("empty.txt", "no_text"), ("gone.md", "error"), ("http://s/none", "error"), (URLS[3], "invalid_url"),
        (URLS[4], "no_subtitles"), ("skip.pdf", "unsupported"),
    ])
    why = {u: d for u, _, d, _ in got}
    assert "BadZipFile" in why["bad.docx"] and why["gone.md"] == "no such file" and why["http://s/none"] == "page was not fetched"
    assert all(n == 0 for *_, n in got)


def test_limits_and_refusals(spark, sources, monkeypatch):
    root = new_table_path(spark, "collections")
    monkeypatch.setattr(ingest, "MOST_BYTES", 8)
    some = ingest.Sources(sources.folder, sources.files.where("uri in ('a.TXT', 'o.org', 't.csv', 'w.DOCX', 'odd.txt')"))
    _, log = ingest.ingest_sources(spark, root, "some", some, chunk=ChunkOptions(max_characters=60))
    got = {r["uri"]: (r["status"], r["detail"]) for r in log.collect()}
    large = ("error", "file is too large")
    assert got == {"a.TXT": large, "o.org": large, "w.DOCX": large, "t.csv": ("loaded", None), "odd.txt": ("loaded", None)} or got["odd.txt"] == large
    with pytest.raises(ValueError, match="no texts"):
        ingest.ingest_sources(spark, root, "none", ingest.Sources())
    with pytest.raises(ValueError, match="embedder"):
        ingest.ingest_sources(spark, root, "none", sources, embedder=None)
    assert not collections.collection_exists(spark, root, "none")


def test_positions_within_a_key(spark):
    rows = [(k, o) for k in ("a", "b") for o in (900, 5, 70_000, 65_536, 6, 200_000)]
    got = number_within(spark.createDataFrame(rows, "k string, o bigint").withColumn("was", F.col("o")), ["k"], "o", block=100).collect()
    assert sorted((r["k"], r["o"], r["was"]) for r in got) == [(k, i, o) for k in ("a", "b") for i, o in enumerate((5, 6, 900, 65_536, 70_000, 200_000))]


TURNS = [
    (1, 0, "user", "old"), (1, 1, "assistant", "reply"), (1, 2, "user", "replaced"), (1, 3, "user", "масло двигатель"),
    (2, 0, "user", "done"), (2, 1, "assistant", "answered"), (3, 0, "user", " \n"), (4, 0, "user", "fail please масло двигатель"),
    (5, 0, "user", "nothing is near"), (6, 0, "user", "масло двигатель"),
]


def _counting(path):
    """A model that notes each call in a file of its own, and fails where it is asked to."""

    def factory():
        import json
        import uuid

        def answer(document):
            (path / uuid.uuid4().hex).write_text("x")
            said = json.loads(document)["messages"]
            if "fail" in said[-1]["content"][-1]["text"]:
                raise RuntimeError("down")
            return f"{len(said)}|{said[-1]['content'][-1]['text']}"

        return answer

    return factory


@pytest.fixture
def calls(tmp_path):
    path = tmp_path / "calls"
    path.mkdir()
    return path


def test_answers_are_kept(spark, calls):
    """A second run asks only for what failed; equal requests go out once; a small round is a job of its own."""
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    kept = new_table_path(spark, "kept")

    def run(**more):
        got = chat.chat_answers(spark, turns, _counting(calls), "m", kept, ChatOptions(history_len=1), **more)
        return {r["conv_id"]: (r["turn"], r["status"], r["answer"], r["error"]) for r in got.collect()}

    want = {
        1: (3, "answered", "3|масло двигатель", None), 3: (0, "blank", None, None), 4: (0, "failed", None, "RuntimeError: down"),
        5: (0, "answered", "1|nothing is near", None), 6: (0, "answered", "1|масло двигатель", None),
    }
    assert run(round_rows=1) == want and len(list(calls.iterdir())) == 4
    assert run() == want and len(list(calls.iterdir())) == 5
    again = spark.createDataFrame([(7, 0, "user", "масло двигатель")], turns.schema)
    got = chat.chat_answers(spark, again, _counting(calls), "m", kept).first()
    assert got["answer"] == "1|масло двигатель" and len(list(calls.iterdir())) == 5
    assert chat.chat_answers(spark, again, _counting(calls), "another", kept).first()["status"] == "answered" and len(list(calls.iterdir())) == 6


def test_answers_from_a_collection(spark, calls):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    root = new_table_path(spark, "collections")
    docs = spark.createDataFrame([("a", 0, "масло для двигатель"), ("b", 1, "Гарантия")], "source_id string, source_ord bigint, text string")
    collections.create_collection(spark, root, "c", jobs.chunk_texts(docs, r"\n"))
    rag = ChatOptions(rag_mode=True, context_template="{context}? {user_message}")
    got = chat.chat_answers(spark, turns, _counting(calls), "m", new_table_path(spark, "kept"), rag, search=SearchOptions(1, 0.6), collection=(root, "c"))
    answers = got.collect()
    assert {r["conv_id"]: r["status"] for r in answers} == {1: "answered", 3: "blank", 4: "failed", 5: "no_context", 6: "answered"}
    assert {r["answer"] for r in answers if r["answer"]} == {"1|масло для двигатель\n? масло двигатель"}
    after = sorted((r["conv_id"], r["turn"], r["role"]) for r in chat.continued(turns, got).collect())
    assert after == [(1, 0, "user"), (1, 1, "assistant"), (1, 3, "user"), (1, 4, "assistant"), (2, 0, "user"), (2, 1, "assistant"), (6, 0, "user"), (6, 1, "assistant")]
    with pytest.raises(ValueError, match="collection"):
        chat.chat_answers(spark, turns, _counting(calls), "m", "x", rag)
    with pytest.raises(ValueError, match="template"):
        chat.chat_answers(spark, turns, _counting(calls), "m", "x", ChatOptions(rag_mode=True, context_template="{context}"), collection=(root, "c"))


def test_a_folder_is_listed_once_for_each_reader(spark, tmp_path):
    for n in range(40):  # more than Spark lists without a job
        (tmp_path / f"k{n}").mkdir()
        for name, text in (("a.txt", f"plain {n}"), ("b.HTML", f"<p>page {n}"), ("c.csv", f"row,{n}\n"), ("d.md.pdf", "none")):
            (tmp_path / f"k{n}" / name).write_text(text)
    uris = [f"k{n}/{name}" for n in range(40) for name in ("a.txt", "b.HTML", "c.csv")]
    wanted = spark.createDataFrame([(u, str(i), i) for i, u in enumerate(uris)], "uri string, source_id string, source_ord bigint")
    context, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    context.setJobGroup("listing", "")
    try:
        whole, records, lost = ingest.read_files(spark, ingest.Sources(str(tmp_path)), wanted, "\n")
    finally:
        context._jsc.sc().clearJobGroup()
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.name.startswith(("load at", "text at")) for s in stages) == 2
    assert spark.conf.get(key) == before
    assert {r["source_ord"]: r["elements"][0]["text"] for r in whole.collect()} == {3 * n + k: f"{said} {n}" for n in range(40) for k, said in enumerate(("plain", "page"))}
    assert sorted((r["source_ord"], r["elem_ord"], r["text"]) for r in records.collect()) == [(3 * n + 2, 0, f"row {n}") for n in range(40)]
    assert not lost.count()
