from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from askloom.sources import files, routing, transcripts


@pytest.mark.parametrize(
    ("uri", "ext", "status"),
    [
        ("a/b.csv", "csv", "loaded"), ("b.TSV", "tsv", "loaded"), ("x.docx", "docx", "loaded"), ("x.MD", "md", "loaded"),
        ("x.org", "org", "loaded"), ("x.pptx", "pptx", "loaded"), ("x.xlsx", "xlsx", "loaded"), ("x.html", "html", "loaded"),
        ("x.txt", "txt", "loaded"), ("x.PDF", "pdf", "unsupported"), ("x.doc", "doc", "unsupported"), ("x.c", "c", "unsupported"),
        ("README", "", "unsupported"), ("dir.csv/README", "", "unsupported"), ("a.tar.md", "md", "loaded"),
    ],
)
def test_gate(spark, uri, ext, status):
    row = routing.gate(spark.createDataFrame([(uri,)], "uri string")).first()
    assert (row["ext"], row["status"]) == (ext, status)


def test_url_list(spark):
    df = spark.createDataFrame([(1, " http://a \n\thttps://www.youtube.com/watch?v=1\n\n"), (2, ""), (3, "  ")], "id bigint, urls string")
    got = [(r["id"], r["url_ord"], r["url"], r["route"]) for r in routing.url_list(df, "id").orderBy("id", "url_ord").collect()]
    assert got == [(1, 0, "http://a", "page"), (1, 1, "https://www.youtube.com/watch?v=1", "video")]


@pytest.mark.parametrize(
    ("url", "found", "valid"),
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&t=1s", "abcdefghijk", True),
        ("https://www.youtube.com/live/abcdefghijk", "abcdefghijk", True),
        ("https://www.youtube.com/live/abcdefghijk&a=b", "abcdefghijk", True),
        ("https://www.youtube.com/live/abcdefghijk?x=1", "abcdefghijk?x=1", False),
        ("https://www.youtube.com/watch?v=abcdefghij", "abcdefghij", False),
    ],
)
def test_video_id(spark, url, found, valid):
    df = spark.createDataFrame([(url,)], "u string")
    row = df.select(routing.video_id(F.col("u")).alias("v")).withColumn("ok", routing.is_video_id(F.col("v"))).first()
    assert (row["v"], row["ok"]) == (found, valid)


def test_union_and_log(spark):
    cols = "source_id string, source_ord bigint, kind string, uri string"
    f = spark.createDataFrame([("a", 0, "file", "a.md"), ("b", 4, "file", "b.pdf")], cols)
    u = spark.createDataFrame([("c", 0, "page", "http://c"), ("d", 1, "page", "http://d")], cols)
    both = routing.union_sources(f, u)
    assert [(r["source_id"], r["source_ord"]) for r in both.orderBy("source_ord").collect()] == [("a", 0), ("b", 4), ("c", 5), ("d", 6)]
    assert [r["source_ord"] for r in routing.union_sources(f.limit(0), u).orderBy("source_ord").collect()] == [0, 1]
    status = both.withColumn("status", F.when(F.col("source_id") == "b", "unsupported").otherwise("loaded")).withColumn("detail", F.lit(None).cast("string"))
    chunks = spark.createDataFrame([("a",), ("a",), ("d",)], "source_id string")
    log = {r["source_id"]: (r["status"], r["n_chunks"]) for r in routing.ingest_log(status, chunks).collect()}
    assert log == {"a": ("loaded", 2), "b": ("unsupported", 0), "c": ("no_text", 0), "d": ("loaded", 1)}
    summary = {r["status"]: (r["n_sources"], r["n_chunks"]) for r in routing.log_summary(routing.ingest_log(status, chunks)).collect()}
    assert summary["loaded"] == (2, 3)


def test_transcripts(spark):
    rows = [
        ("both", "ru", True, 0, "auto"), ("both", "ru", False, 1, "two"), ("both", "ru", False, 0, "one"),
        ("auto", "ru", True, 0, "a"), ("auto", "ru", True, 1, "b"), ("other", "en", False, 0, "e"),
    ]
    t = spark.createDataFrame(rows, "video_id string, lang string, is_generated boolean, seq bigint, text string")
    got = {r["video_id"]: (r["is_generated"], r["text"]) for r in transcripts.transcript_text(t, "ru").collect()}
    assert got == {"both": (False, "one\ntwo"), "auto": (True, "a\nb")}
    videos = spark.createDataFrame([("both",), ("auto",), ("other",), ("none",)], "video_id string")
    status = {r["video_id"]: (r["status"], r["detail"]) for r in transcripts.transcript_status(videos, t, "ru").collect()}
    assert status == {"both": ("loaded", "manual"), "auto": ("loaded", "automatic"), "other": ("lang_missing", None), "none": ("no_subtitles", None)}
    lines = transcripts.transcript_elements(t, "ru").orderBy("source_id", "elem_ord").collect()
    assert [(r["source_id"], r["text"]) for r in lines] == [("auto", "a"), ("auto", "b"), ("both", "one"), ("both", "two")]
    # any code is a language; a video without it has no text in it
    assert transcripts.transcript_text(t, "de").collect() == []
    assert [r["text"] for r in transcripts.transcript_text(t, "en").collect()] == ["e"]
    with pytest.raises(ValueError):
        transcripts.transcript_text(t, " ")


def test_csv_records_are_numbered_across_splits(spark, tmp_path):
    lines = [f"{i}, name {i} ,{'x' * 50}" for i in range(3000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "small.csv").write_text("a,,b\n,,\n\"q,1\",z\n", encoding="utf-8")
    limit = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20000")
    try:
        rows = files.csv_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(limit, before)
    by_file: dict = {}
    for r in rows:
        by_file.setdefault(r["source_id"].rsplit("/", 1)[1], {})[r["elem_ord"]] = r["text"]
    assert [by_file["small.csv"][i] for i in range(len(by_file["small.csv"]))] == ["a b", "q,1 z"]
    assert [by_file["big.csv"][i] for i in range(3000)] == [f"{i} name {i} {'x' * 50}" for i in range(3000)]


def test_tsv_and_whole_text_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb c\nd\te\n", encoding="utf-8")
    assert [r["text"] for r in files.csv_elements(spark, str(tmp_path / "t.tsv"), sep="\t").orderBy("elem_ord").collect()] == ["a b c", "d e"]
    (tmp_path / "n.md").write_text("# Масло\nтекст\n", encoding="utf-8")
    doc = files.document_files(spark, str(tmp_path / "n.md"))
    got = files.explode_elements(doc.select("source_id", files.elements_of("md", F.col("text")).alias("elements")), "source_id")
    assert [(r["elem_ord"], r["category"], r["text"]) for r in got.collect()] == [(0, "Title", "Масло"), (1, "NarrativeText", "текст")]


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)


def test_office_files(spark, tmp_path):
    _zip(tmp_path / "a.docx", {"word/document.xml": (
        '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>it</w:t></w:r><w:r><w:t>em</w:t></w:r></w:p><w:p/></w:body></w:document>')})
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sp></p:sld>'
    _zip(tmp_path / "b.pptx", {"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two")})
    _zip(tmp_path / "c.XLSX", {
        "xl/sharedStrings.xml": '<sst xmlns="s"><si><t>масло</t></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'})
    (tmp_path / "d.docx").write_bytes(b"damaged")
    (tmp_path / "e.pdf").write_bytes(b"ignored")
    got: dict = {}
    for r in files.office_elements(files.office_files(spark, str(tmp_path))).collect():
        got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append((r["elem_ord"], r["category"], r["text"], bool(r["error"])))
    assert got["a.docx"] == [(0, "Title", "Head", False), (1, "ListItem", "item", False)]
    assert got["b.pptx"] == [(0, "Title", "two", False), (1, "Title", "ten", False)]
    assert got["c.XLSX"] == [(0, "NarrativeText", "масло 5", False)]
    assert got["d.docx"] == [(None, None, None, True)] and "e.pdf" not in got


def test_ragged_and_quoted_records(spark, tmp_path):
    """Cells beyond the first record's width stay, as do separators and doubled quotes inside quotes."""
    (tmp_path / "a.csv").write_text('x,y\n1,2,LOST,LOST2\n"say ""hi"", ok",b\n,,\n"open,c\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(' one \n,"", two ,"three"\r\n', encoding="utf-8")
    got = files.csv_elements(spark, str(tmp_path)).orderBy("source_id", "elem_ord").collect()
    assert [(r.elem_ord, r.text) for r in got] == [
        (0, "x y"), (1, "1 2 LOST LOST2"), (2, 'say "hi", ok b'), (3, '"open c'), (0, "one"), (1, "two three"),
    ]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "m.csv").write_text('a,"b\nc"\nd\n', encoding="utf-8")
    many = files.csv_elements(spark, str(tmp_path / "c"), multi_line=True).orderBy("elem_ord").collect()
    assert [(r.elem_ord, r.text) for r in many] == [(0, "a b\nc"), (1, "d")]


def _archive(member: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(member, xml)
    return out.getvalue()


def test_office_texts_by_hand(spark):
    run = "<w:r><w:t>{}</w:t></w:r>"
    box = "<w:r><w:pict><w:txbxContent><w:p>" + run.format("inner") + "</w:p></w:txbxContent></w:pict></w:r>"
    body = "<w:p><w:r><w:t>oil</w:t><w:br/><w:t>level</w:t><w:tab/><w:t>1,1</w:t></w:r></w:p><w:p>" + run.format("outer") + box + "</w:p>"
    docx = _archive("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    cell = "<a:tc><a:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = "<p:graphicFrame><a:tbl><a:tr>" + cell.format("a") + cell.format("b") + "</a:tr></a:tbl></p:graphicFrame>"
    pptx = _archive("ppt/slides/slide1.xml", f'<p:sld xmlns:p="p" xmlns:a="a">{table}</p:sld>')
    df = spark.createDataFrame([("x.docx", docx), ("y.pptx", pptx)], "source_id string, content binary")
    got = {(r.source_id, r.elem_ord): r.text for r in files.office_elements(df).collect()}
    assert got == {("x.docx", 0): "oil\nlevel\t1,1", ("x.docx", 1): "outer", ("x.docx", 2): "inner", ("y.pptx", 0): "a b"}


def test_no_local_work_folder_on_a_cluster():
    from types import SimpleNamespace

    from askloom.session import work_dir

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        work_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_url_status(spark):
    urls = "https://www.youtube.com/watch?v=abcdefghijk&t=1 https://www.youtube.com/live/short https://site.org/a"
    rows = routing.url_list(spark.createDataFrame([(1, urls), (2, None)], "id int, urls string"), "id")
    assert [r.status for r in routing.url_status(rows).orderBy("url_ord").collect()] == ["loaded", "invalid_url", "loaded"]
