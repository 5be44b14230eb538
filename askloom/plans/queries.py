"""One query per operator over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import vectors as V
from askloom.operators import conversation as C
from askloom.operators import prompting as P
from askloom.operators.cells import nearest_in_cells, write_cells
from askloom.operators.chunking import chunk_documents, chunk_elements
from askloom.operators.embedding import Embedder, embed_texts, hash_embed, idf_table, term_counts, weigh
from askloom.operators.generation import batch_generate
from askloom.operators.lsh import nearest_approx, nearest_indexed, write_index
from askloom.operators.ordering import assign_chunk_ids
from askloom.operators.preview import line_count, preview_lines
from askloom.operators.search import filter_by_distance, nearest, nearest_to_one, rank_hits
from askloom.options import ChatOptions, ChunkOptions, CleanOptions, EmbedOptions, PreviewOptions, SearchOptions
from askloom.plans import chat, ingest, jobs
from askloom.session import materialize, new_table_path, scan
from askloom.sources import collections, files, routing, transcripts
from askloom.streaming.ingest import ingest_stream, latest_versions, prompt_stream, search_ingested
from askloom.streaming.turns import latest_user_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE = r"\n"
DIM = 64
SMALL = ChunkOptions(max_characters=200, new_after_n_chars=100, overlap=20)
ALL_STEPS = CleanOptions(dashes=True, lowercase=True)
LEADS = ("• ", "●▪ ", " · ", "")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_ord"), "text"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("string").alias("source_id"), F.col("page_id").alias("source_ord"), "url", "html"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def led_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with bullets, NBSP and uneven blanks put in front, by line number."""
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("line") % len(LEADS) + 1).cast("int"))
    lines = documents(spark, sf_dir).select(
        F.col("source_ord").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return lines.select("doc_id", "line", F.concat(lead, F.lit("\t"), F.col("text"), F.lit("  ")).alias("text"))


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.elements_in_rows(documents(spark, sf_dir), T.text_elements(F.col("text"), LINE))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(document_elements(spark, sf_dir))


def stored_documents(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Root and name of a collection of the documents, built for this query."""
    root = new_table_path(spark, "collections")
    collections.create_collection(spark, root, "123", document_chunks(spark, sf_dir))
    return root, "123"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")


def _mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    means = (
        rows.select(key, F.posexplode("embedding").alias("i", "x"))
        .groupBy(key, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(key).agg(ordered["m"].alias("embedding"))


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per label: the mean vector of its rows."""
    return _mean_vectors(vectors(spark, sf_dir), "label").select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which short answers count as user turns, so users speak twice in a row."""
    short = (F.col("role") == "assistant") & (F.length("text") < 400)
    return table(spark, sf_dir, "conversations").withColumn("role", F.when(short, "user").otherwise(F.col("role")))


def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: answers are the automatic track, the rest the manual one."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("video"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("video_id"),
        F.when(F.col("conv_id") % 3 == 0, "en").otherwise("ru").alias("lang"),
        (F.col("role") == "assistant").alias("is_generated"),
        F.col("turn").alias("seq"),
        "text",
    )


EXTENSIONS = ("csv", "TSV", "docx", "md", "org", "pptx", "xlsx", "html", "txt", "pdf", "doc", "c", "tar.md", "")


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per document, with extensions in turn."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("doc_id").alias("source_ord"),
        F.lit("file").alias("kind"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias("uri"),
    )


def url_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page a white-space separated list: its own URL and three forms of video links."""
    code = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    site = F.lit("https://www.youtube.com/")
    links = F.concat(
        F.lit(" \n"), F.col("url"), F.lit("\t"), site, F.lit("watch?v="), code, F.lit("&t=7s  "),
        site, F.lit("live/"), code, F.lit("\n"), site, F.lit("live/"), code, F.lit("?x=1 "),
    )
    return table(spark, sf_dir, "pages").select("page_id", links.alias("urls"))


def tokens_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select(
        F.col("query_id").alias("answer_id"), F.posexplode(F.split("text", " ")).alias("seq", "word")
    ).select("answer_id", F.col("seq").cast("bigint").alias("seq"), F.concat("word", F.lit(" ")).alias("tok"))


# ---------------------------------------------------------------- sources


@query
def source_gate(spark, sf_dir):
    return routing.gate(file_list(spark, sf_dir)).select("source_id", "uri", "ext", "status")


@query
def url_route(spark, sf_dir):
    return routing.url_list(url_cells(spark, sf_dir), "page_id")


@query
def video_id(spark, sf_dir):
    listed = routing.url_list(url_cells(spark, sf_dir), "page_id").where(F.col("route") == "video")
    found = routing.video_id(F.col("url"))
    return listed.select("page_id", "url_ord", found.alias("video_id"), routing.is_video_id(found).alias("valid"))


@query
def url_status(spark, sf_dir):
    """Every third video link loses a character of its id."""
    listed = routing.url_list(url_cells(spark, sf_dir), "page_id")
    short = (F.col("route") == "video") & (F.col("page_id") % 3 == 0) & (F.col("url_ord") == 2)
    cut = listed.withColumn("url", F.when(short, F.expr("left(url, length(url) - 1)")).otherwise(F.col("url")))
    return routing.url_status(cut).select("page_id", "url_ord", "url", "status")


@query
def ingest_union(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(
        F.col("url").alias("source_id"), F.col("page_id").alias("source_ord"), F.lit("page").alias("kind"), F.col("url").alias("uri")
    )
    return routing.union_sources(file_list(spark, sf_dir), urls)


@query
def ingest_log(spark, sf_dir):
    gated = routing.gate(file_list(spark, sf_dir)).withColumn("detail", F.col("ext"))
    readable = gated.where(F.col("status") == "loaded").select("source_id")
    chunks = document_chunks(spark, sf_dir).join(readable, "source_id", "left_semi")
    return routing.log_summary(routing.ingest_log(gated, chunks))


def in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in partitions of consecutive keys, sorted, to be written to one file each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def numbered_over_files(found: DataFrame, folder: Column) -> DataFrame:
    """Elements numbered through all files of their folder, in the order of the file names, from the counts per file."""
    files_ = found.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("folder", folder)
    before = Window.partitionBy("folder").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files_.select("source_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return found.join(F.broadcast(offsets), "source_id").withColumn("elem_ord", F.col("elem_ord") + F.col("first")).drop("first")


@query
def csv_elements(spark, sf_dir):
    """Records of two folders of different width, with commas, doubled quotes and empty cells."""
    path = new_table_path(spark, "csv")
    flat = F.regexp_replace("text", r"\s+", " ")
    rows = table(spark, sf_dir, "documents").withColumn("text", flat)
    said = F.concat(F.lit('say "'), "source", F.lit('", ok'))
    short = rows.where("doc_id % 2 = 0").select("doc_id", "text")
    long = rows.where("doc_id % 2 = 1").select("doc_id", F.lit(None).cast("string"), "lang", said, "text")
    for name, part in (("short", short), ("long", long)):
        in_ranges(part, "doc_id").write.option("escape", '"').csv(f"{path}/{name}")
    part = F.regexp_extract("source_id", "/(short|long)/", 1)
    found = numbered_over_files(files.csv_elements(spark, f"{path}/*"), part)
    return found.select("category", part.alias("part"), "elem_ord", "text")


@query
def tsv_elements(spark, sf_dir):
    path = new_table_path(spark, "tsv")
    flat = F.regexp_replace("text", r"\s+", " ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", flat.alias("text"))
    in_ranges(rows, "conv_id", "turn").write.option("sep", "\t").option("escape", '"').csv(path)
    return numbered_over_files(files.csv_elements(spark, path, sep="\t"), F.lit("")).select("category", "elem_ord", "text")


# One file of each kind for so many ids; the last two kinds are listed only.
FILE_KINDS = ("txt", "md", "html", "csv", "docx", "pdf", "gone.txt")
FILE_IDS = 200


# Calls to the file system at a time.
RENAMES = 16


def _part_names(spark: SparkSession, folder: str) -> list[str]:
    """The files in the folders of a partitioned table, below it, in one answer of the driver's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is None:
        return []
    paths = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    return re.findall(r"/([^/]+/part-[^/,}]+)", paths)


def _renamed(spark: SparkSession, folder: str, ext: str) -> None:
    """Give the files of a folder their extension: Spark's text writer knows one only."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(name: str) -> None:
        fs.rename(path(f"{folder}/{name}"), path(f"{folder}/{name.rsplit('.', 1)[0]}.{ext}"))

    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(rename, _part_names(spark, folder)))


def _docx_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [_office_bytes("docx", [line for d in sorted(docs, key=lambda d: d["doc_id"]) for line in d["text"].split("\n")]) for docs in batch["docs"]]
        # every fourth file is damaged
        cut = [m[: len(m) // 2] if b % 4 == 1 else m for b, m in zip(batch["bundle"], made)]
        yield pd.DataFrame({"bundle": batch["bundle"], "value": cut})


def written_documents(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The documents as text, outline, web, table and office files, and the list of these and some that are not there."""
    folder = new_table_path(spark, "files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 5).alias("k"), F.floor(F.col("doc_id") / FILE_IDS).alias("bundle"))
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    web = F.concat(F.lit("<h2>"), "doc_id", F.lit("</h2><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    values = {"txt": F.col("text"), "md": F.concat(F.lit("# "), "text"), "html": web, "csv": F.regexp_replace("text", r"\s+", " ")}
    for k, (kind, value) in enumerate(values.items()):
        rows = docs.where(F.col("k") == k).repartition("bundle").sortWithinPartitions("bundle", "doc_id")
        if kind == "csv":
            rows.select("bundle", "doc_id", value.alias("text")).write.partitionBy("bundle").option("escape", '"').csv(f"{folder}/csv")
        else:
            rows.select("bundle", value.alias("value")).write.partitionBy("bundle").text(f"{folder}/{kind}")
    office = docs.where("k = 4").groupBy("bundle").agg(F.collect_list(F.struct("doc_id", "text")).alias("docs")).mapInPandas(_docx_rows, "bundle bigint, value binary")
    office.withColumn("value", F.col("value").cast("string")).write.partitionBy("bundle").text(f"{folder}/docx")
    for kind in ("md", "html", "docx"):
        _renamed(spark, f"{folder}/{kind}", kind)
    uris = [f"{kind}/{name}" for kind in FILE_KINDS[:5] for name in _part_names(spark, f"{folder}/{kind}")]
    named = spark.createDataFrame(pa.table({"uri": pa.array([u for u in uris if re.fullmatch("[a-z]+/bundle=[0-9]+/part-.+", u)], pa.string())}))
    kind = F.array_position(F.array(*map(F.lit, FILE_KINDS)), F.substring_index("uri", "/", 1)) - 1
    bundle = F.regexp_extract("uri", "bundle=([0-9]+)", 1).cast("bigint")
    known = named.select("uri", (kind + bundle * len(FILE_KINDS)).alias("source_ord"))
    absent = docs.select("bundle").distinct().select("bundle", F.explode(F.array(F.lit(5), F.lit(6))).alias("k"))
    absent = absent.select(
        F.concat(F.lit("more/"), "bundle", F.when(F.col("k") == 5, ".pdf").otherwise(".txt")).alias("uri"), (F.col("k") + F.col("bundle") * len(FILE_KINDS)).alias("source_ord")
    )
    return folder, materialize(known.unionByName(absent), "files")


def _all_sources(spark: SparkSession, sf_dir: str) -> ingest.Sources:
    """Documents as files, fetched pages (every fiftieth is missing) and conversations as subtitles (some URLs are wrong)."""
    folder, listed = written_documents(spark, sf_dir)
    fetched = table(spark, sf_dir, "pages")
    n_pages = fetched.agg(F.coalesce(F.max("page_id") + 1, F.lit(0))).scalar()
    code = F.lpad(F.col("conv_id").cast("string"), 6, "0")
    site = F.lit("https://www.youtube.com/")
    link = (
        F.when(F.col("conv_id") % 10 == 9, F.concat(site, F.lit("live/video"), code, F.lit("?x=1")))
        .when(F.col("conv_id") % 10 == 8, F.concat(site, F.lit("live/no-id"), code))
        .otherwise(F.concat(site, F.lit("watch?v=video"), code, F.lit("&t=1s")))
    )
    videos = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(link.alias("url"), (F.col("conv_id") + n_pages).alias("source_ord"))
    urls = fetched.select("url", F.col("page_id").alias("source_ord")).unionByName(videos)
    return ingest.Sources(folder, listed, urls, fetched.where("page_id % 50 <> 7"), transcript_rows(spark, sf_dir))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ingest.ingest_sources(spark, new_table_path(spark, "collections"), "123", _all_sources(spark, sf_dir), sep=LINE)


@query
def ingest_sources(spark, sf_dir):
    """Files, pages and subtitles to one collection."""
    return _ingested(spark, sf_dir)[0].select("chunk_id", "source_ord", "chunk_ord", "text")


@query
def ingest_sources_log(spark, sf_dir):
    """What became of every source of the same job."""
    return _ingested(spark, sf_dir)[1].select("source_id", "status", "n_chunks")


@query
def md_elements(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source_ord", F.concat(F.lit("# "), "text").alias("text"))
    outlined = docs.select("source_ord", files.elements_of("md", F.col("text")).alias("elements"))
    return files.explode_elements(outlined, "source_ord")


@query
def org_elements(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source_ord", F.concat(F.lit("** "), "text").alias("text"))
    outlined = docs.select("source_ord", files.elements_of("org", F.col("text")).alias("elements"))
    return files.explode_elements(outlined, "source_ord")


def _office_bytes(kind: str, lines: list[str]) -> bytes:
    """A minimal office file holding one line per paragraph, slide text or sheet row."""
    safe = [escape(line) for line in lines]
    if kind == "docx":
        member, body = "word/document.xml", "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in safe)
        xml = f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'
    elif kind == "pptx":
        member, body = "ppt/slides/slide1.xml", "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in safe)
        xml = f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody>{body}</p:txBody></p:sp></p:sld>'
    else:
        rows = "".join(f'<row><c t="inlineStr"><is><t>{t}</t></is></c></row>' for t in safe)
        member, xml = "xl/worksheets/sheet1.xml", f'<worksheet xmlns="s"><sheetData>{rows}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(member, xml)
    return out.getvalue()


def _office_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of ``source_id, lines``, one at a time, as they are read: a whole batch would be held several times over."""
    for batch in batches:
        for name, lines in zip(batch.column("source_id"), batch.column("lines")):
            made = _office_bytes(name.as_py().rsplit(".", 1)[1], lines.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([made], pa.binary())], names=["source_id", "content"])


@query
def ooxml_elements(spark, sf_dir):
    kinds = F.array(F.lit("docx"), F.lit("pptx"), F.lit("xlsx"))
    docs = documents(spark, sf_dir).select(
        F.concat("source_id", F.lit("."), F.element_at(kinds, (F.col("source_ord") % 3 + 1).cast("int"))).alias("source_id"),
        F.split("text", "\n").alias("lines"),
    )

    content = docs.mapInArrow(_office_files, "source_id string, content binary")
    return files.office_elements(content)


@query
def page_elements(spark, sf_dir):
    found = pages(spark, sf_dir).select("source_ord", T.html_elements(F.col("html")).alias("elements"))
    return files.explode_elements(found, "source_ord")


@query
def transcript_text(spark, sf_dir):
    return transcripts.transcript_text(transcript_rows(spark, sf_dir), "ru")


@query
def transcript_status(spark, sf_dir):
    videos = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("video"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("video_id")
    )
    return transcripts.transcript_status(videos, transcript_rows(spark, sf_dir), "ru")


# ---------------------------------------------------------------- elements and cleaning


@query
def text_elements(spark, sf_dir):
    split = documents(spark, sf_dir).select("source_ord", T.text_elements(F.col("text"), LINE).alias("elements"))
    return files.explode_elements(split, "source_ord")


def _cleaning(name: str, step) -> None:
    def run(spark, sf_dir):
        return led_lines(spark, sf_dir).select("doc_id", "line", step(F.col("text")).alias("text"))

    run.__name__ = name
    query(run)


_cleaning("clean_bullets", T.clean_bullets)
_cleaning("clean_whitespace", T.clean_whitespace)
_cleaning("clean_dashes", T.clean_dashes)
_cleaning("clean_trailing", T.clean_trailing)
_cleaning("clean_lower", T.clean_lower)
_cleaning("clean_all", lambda c: T.clean(c, ALL_STEPS))


# ---------------------------------------------------------------- chunking

CHUNKED = ("source_ord", "chunk_ord", "text", "n_chars")


@query
def chunk_basic(spark, sf_dir):
    return document_chunks(spark, sf_dir).select(*CHUNKED)


@query
def chunk_rows(spark, sf_dir):
    """The same chunks as ``chunk_basic`` from one element per row, with long sources cut to blocks."""
    rows = files.explode_elements(document_elements(spark, sf_dir), "source_id", "source_ord")
    return chunk_elements(rows).select(*CHUNKED)


@query
def chunk_text(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("source_id"), (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("source_ord"), "text"
    )
    return jobs.chunk_texts(texts, LINE, ALL_STEPS, SMALL).select(*CHUNKED)


@query
def split_oversized(spark, sf_dir):
    pieces = T.split_oversized(F.col("text"), 100)
    cut = documents(spark, sf_dir).select("source_ord", F.posexplode_outer(pieces).alias("piece_no", "piece"))
    return cut.where(F.col("piece").isNotNull())


@query
def split_overlap(spark, sf_dir):
    pieces = T.split_oversized(F.col("text"), 100, 20)
    return questions(spark, sf_dir).select("query_id", F.posexplode(pieces).alias("piece_no", "piece"))


@query
def chunk_by_title(spark, sf_dir):
    elements = jobs.elements_in_rows(pages(spark, sf_dir), T.html_elements(F.col("html")))
    return chunk_documents(elements, ChunkOptions(chunking_strategy="by_title")).select(*CHUNKED)


@query
def chunk_ids(spark, sf_dir):
    staged = materialize(document_chunks(spark, sf_dir), "chunks")
    return assign_chunk_ids(staged).select("source_ord", "chunk_ord", "chunk_id", "n_chars")


@query
def render_chunks(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("source_ord", "chunk_ord", T.render(F.col("text")).alias("text"))


# ---------------------------------------------------------------- collections


@query
def build_collection(spark, sf_dir):
    root = new_table_path(spark, "collections")
    _, log = jobs.build_collection(spark, root, "123", document_elements(spark, sf_dir))
    return log.select("source_id", "uri", "status", "n_chunks")


@query
def collection_roundtrip(spark, sf_dir):
    """Create, replace by another content, read: only the second content is left."""
    root = new_table_path(spark, "collections")
    collections.create_collection(spark, root, "123", jobs.chunk_texts(documents(spark, sf_dir), LINE, chunk=SMALL))
    collections.create_collection(spark, root, "456", document_chunks(spark, sf_dir))
    collections.create_collection(spark, root, "123", document_chunks(spark, sf_dir))
    collections.delete_collection(spark, root, "456")
    stored = collections.collection_chunks(spark, root, "123")
    return stored.select("collection", "chunk_id", "source_ord", "chunk_ord", "text")


@query
def collections_exist(spark, sf_dir):
    """All conversations as names; the documents are stored under the first of them."""
    root = new_table_path(spark, "collections")
    names = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name"), "conv_id")
    first = names.agg(F.min("conv_id").cast("string").alias("name")).first()["name"]
    if first is not None:
        collections.create_collection(spark, root, first, document_chunks(spark, sf_dir))
    return collections.collections_exist(spark, root, names.where("name is not null").select("name").distinct())


@query
def template_status(spark, sf_dir):
    """Conversation texts as templates, with names put in by conversation."""
    safe = F.regexp_replace("text", r"[{}]", "")
    both = (F.col("conv_id") % 3 == 2) | ((F.col("conv_id") % 3 == 0) & F.contains("text", F.lit("x")))
    context = F.when((F.col("conv_id") % 3 == 1) | (F.col("conv_id") % 3 == 2), "{context}").otherwise("{{context}}")
    message = F.when(both, "{user_message}").otherwise("")
    templates = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(safe, context, message).alias("template"))
    return templates.select("conv_id", "turn", P.template_status(F.col("template")).alias("status"))


@query
def collection_scan(spark, sf_dir):
    root, name = stored_documents(spark, sf_dir)
    return collections.collection_chunks(spark, root, name).select("collection", "chunk_id", "source_id", "n_chars")


@query
def collection_count(spark, sf_dir):
    root, name = stored_documents(spark, sf_dir)
    return collections.collection_count(spark, root, name)


@query
def retrieve_all(spark, sf_dir):
    root, name = stored_documents(spark, sf_dir)
    return collections.retrieve_all(spark, root, name)


# ---------------------------------------------------------------- embedding


def _postings(vectors_: DataFrame, key: str) -> DataFrame:
    pairs = vectors_.select(key, F.explode_outer(F.arrays_zip("buckets", "weights")).alias("p")).where(F.col("p").isNotNull())
    return pairs.select(key, F.col("p.buckets").alias("bucket"), F.round("p.weights", 6).alias("w"))


def _document_terms(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source_ord").alias("chunk_id"), "text")
    return materialize(term_counts(docs, "chunk_id"), "terms")


@query
def hash_embed_(spark, sf_dir):
    counts = _document_terms(spark, sf_dir)
    idf_values = materialize(idf_table(counts), "idf").select("idf").scalar()
    return _postings(weigh(counts, "chunk_id", idf_values), "chunk_id")


@query
def embed_queries(spark, sf_dir):
    idf_values = idf_table(_document_terms(spark, sf_dir)).select("idf").scalar()
    return _postings(hash_embed(questions(spark, sf_dir), "query_id", idf_values), "query_id")


def _letter_model():
    """A deterministic stand-in for a model: how often each of the 26 letters occurs."""

    def encode(texts):
        return [[t.count(chr(97 + i)) for i in range(26)] for t in map(str.lower, texts)]

    return encode


@query
def embed_udf(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source_ord", "text")
    found = embed_texts(docs, "source_ord", _letter_model, opts=EmbedOptions(normalize_embeddings=True))
    first = F.round(F.col("embedding")[4].cast("double"), 3)
    return found.select("source_ord", F.size("embedding").alias("dim"), first.alias("share_e"), "error")


@query
def l2_normalize(spark, sf_dir):
    moved = F.transform("embedding", lambda x: x.cast("double") + 0.25)
    unit = V.l2_normalize(moved)
    return vectors(spark, sf_dir).select("chunk_id", F.posexplode_outer(unit).alias("i", "x")).select(
        "chunk_id", "i", F.round("x", 6).alias("x")
    )


# ---------------------------------------------------------------- retrieval


def _to_centre(distance) -> Query:
    def run(spark, sf_dir):
        centres = label_centres(spark, sf_dir).select(F.col("query_id").alias("label"), F.col("embedding").alias("centre"))
        pairs = vectors(spark, sf_dir).withColumn("label", F.col("label").cast("bigint")).join(centres, "label")
        return pairs.select("chunk_id", "label", V.rounded(distance(F.col("embedding"), F.col("centre"))).alias("distance"))

    return run


for _name, _distance in V.DISTANCES.items():
    QUERIES[f"{_name}_distance"] = _to_centre(_distance)


@query
def topk_single(spark, sf_dir):
    """Nearest vectors to the mean of all."""
    rows = vectors(spark, sf_dir)
    centre = _mean_vectors(rows.withColumn("all", F.lit(0)), "all").select("embedding")
    return nearest_to_one(rows, centre, SearchOptions(n_results=5, max_distance=0.9))


def _nearest_centres(opts: SearchOptions, limited: bool = True) -> Query:
    def run(spark, sf_dir):
        return nearest(vectors(spark, sf_dir), label_centres(spark, sf_dir), opts, dim=DIM, limited=limited)

    return run


QUERIES["knn_join"] = _nearest_centres(SearchOptions(n_results=5), limited=False)
QUERIES["knn_l2"] = _nearest_centres(SearchOptions(n_results=3, max_distance=2, space="l2"))
QUERIES["knn_ip"] = _nearest_centres(SearchOptions(n_results=3, max_distance=2, space="ip"))


@query
def knn_threshold(spark, sf_dir):
    """Top-k first, then the inclusive limit."""
    hits = QUERIES["knn_join"](spark, sf_dir)
    return filter_by_distance(hits, 0.65)


@query
def range_search(spark, sf_dir):
    opts = SearchOptions(n_results="max", max_distance=0.9)
    hits = nearest(vectors(spark, sf_dir), label_centres(spark, sf_dir), opts, dim=DIM)
    return rank_hits(materialize(hits, "hits"))


@query
def knn_lsh(spark, sf_dir):
    opts = SearchOptions(n_results=5, max_distance=2)
    return nearest_approx(vectors(spark, sf_dir), label_centres(spark, sf_dir), opts, dim=DIM)


@query
def knn_indexed(spark, sf_dir):
    """The same from a stored index, of which only the buckets of the questions are read."""
    path = new_table_path(spark, "index")
    write_index(vectors(spark, sf_dir), path, dim=DIM)
    opts = SearchOptions(n_results=5, max_distance=2)
    return nearest_indexed(spark, path, label_centres(spark, sf_dir), opts, dim=DIM)


def _cells_of_vectors(spark, sf_dir, opts: SearchOptions) -> DataFrame:
    path, cells = new_table_path(spark, "index"), new_table_path(spark, "cells")
    write_cells(vectors(spark, sf_dir), path, cells, dim=DIM, space=opts.space)
    return nearest_in_cells(spark, path, cells, label_centres(spark, sf_dir), opts, dim=DIM)


@query
def knn_cells(spark, sf_dir):
    """Exact top-k from an index of cells."""
    return _cells_of_vectors(spark, sf_dir, SearchOptions(n_results=5, max_distance=2))


@query
def knn_cells_l2(spark, sf_dir):
    return _cells_of_vectors(spark, sf_dir, SearchOptions(n_results=3, max_distance=2, space="l2"))


@query
def sparse_knn(spark, sf_dir):
    """Questions against whole documents under tf-idf."""
    counts = _document_terms(spark, sf_dir)
    idf_values = materialize(idf_table(counts), "idf").select("idf").scalar()
    asked = hash_embed(questions(spark, sf_dir), "query_id", idf_values)
    return nearest(weigh(counts, "chunk_id", idf_values), asked, SearchOptions(n_results=3, max_distance=0.8))


# ---------------------------------------------------------------- prompts


def _document_hits(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source_ord").alias("chunk_id"), "text")
    return P.with_texts(sparse_knn(spark, sf_dir), docs)


@query
def context_concat(spark, sf_dir):
    return P.contexts(_document_hits(spark, sf_dir))


@query
def prompt_fill(spark, sf_dir):
    turns_ = table(spark, sf_dir, "conversations")
    template = "{{ctx}} {context}\n--\n{user_message} / {context}"
    filled = P.fill_template(template, context=F.concat("role", F.lit("{user_message}")), user_message=F.col("text"))
    return turns_.select("conv_id", "turn", filled.alias("prompt"))


@query
def no_context_questions(spark, sf_dir):
    return P.no_context(questions(spark, sf_dir), sparse_knn(spark, sf_dir))


@query
def blank_filter(spark, sf_dir):
    blanked = F.when(F.col("role") == "system", F.lit(" \t \n ")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").withColumn("text", blanked)
    return P.not_blank(rows).select("conv_id", "turn", "text")


@query
def effective_message(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit("ctx: "), F.col("text"))
    chosen = P.effective_message(F.col("role") == "user", prompt, F.col("text"))
    return rows.select("conv_id", "turn", chosen.alias("message"))


@query
def rag_prompts(spark, sf_dir):
    """Documents to chunks to a collection; every benchmark item is a question against it."""
    root, name = stored_documents(spark, sf_dir)
    return jobs.rag_prompts(spark, root, name, questions(spark, sf_dir))


@query
def rag_prompts_model(spark, sf_dir):
    """The same with a user-supplied dense model."""
    root, model = new_table_path(spark, "collections"), Embedder("letters", _letter_model)
    jobs.build_collection(spark, root, "123", document_elements(spark, sf_dir), embedder=model)
    opts = SearchOptions(n_results=2, max_distance=0.01)
    return jobs.rag_prompts(spark, root, "123", questions(spark, sf_dir), opts, embedder=model)


@query
def rag_prompts_indexed(spark, sf_dir):
    """The same from a collection whose vectors are stored by cell."""
    root, model = new_table_path(spark, "collections"), Embedder("letters", _letter_model)
    jobs.build_collection(spark, root, "123", document_elements(spark, sf_dir), embedder=model, index="cosine")
    opts = SearchOptions(n_results=2, max_distance=0.01)
    return jobs.rag_prompts(spark, root, "123", questions(spark, sf_dir), opts, embedder=model)


@query
def rag_prompts_max(spark, sf_dir):
    """All chunks within the limit go into the context, nearest first."""
    root, name = stored_documents(spark, sf_dir)
    found = jobs.rag_prompts(spark, root, name, questions(spark, sf_dir), SearchOptions(n_results="max", max_distance=0.6))
    return found.select("query_id", "status", "n_hits", "prompt")


# ---------------------------------------------------------------- conversations


@query
def collapse_user_turns(spark, sf_dir):
    return C.collapse_user_turns(turns(spark, sf_dir))


def _flat(history):
    return F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), " | ")


@query
def history_window(spark, sf_dir):
    framed = C.history_window(turns(spark, sf_dir), 2)
    return framed.select("conv_id", "turn", F.size("history").alias("n"), _flat(F.col("history")).alias("history"))


def _spoken(messages):
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"][0]["text"])), " | "
    )


@query
def system_prepend(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    prompt = F.when(F.col("role") == "system", F.col("text")).otherwise(F.lit(""))
    made = C.system_messages(prompt, F.col("turn") < 5)
    return rows.select("conv_id", "turn", F.size(made).alias("n"), _spoken(made).alias("messages"))


def _with_parts(spark, sf_dir) -> DataFrame:
    """Turns as content parts: every assistant turn has no file, others have one, by suffix in turn."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".PNG", ".webp", ".gif", "", ".tar.jpg")]), (F.col("conv_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("up/"), F.col("conv_id"), suffix)
    file_part = F.struct(F.lit("file").alias("type"), F.lit(None).cast("string").alias("text"), path.alias("path"))
    text_part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("path"))
    none = F.array().cast("array<struct<type:string,text:string,path:string>>")
    parts = F.when(F.col("role") == "assistant", F.array(text_part)).when(F.col("role") == "user", F.array(file_part, text_part)).otherwise(none)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("parts"))


@query
def content_parts(spark, sf_dir):
    return _with_parts(spark, sf_dir).select(
        "conv_id", "turn", C.last_text(F.col("parts")).alias("text"), C.first_file(F.col("parts")).alias("path")
    )


@query
def attachment_filter(spark, sf_dir):
    path = C.first_file(F.col("parts"))
    return _with_parts(spark, sf_dir).where(C.is_image(path)).select("conv_id", "turn", path.alias("path"))


def _messages(spark, sf_dir) -> DataFrame:
    """Every user turn that stands becomes a request with two pairs of history."""
    framed = C.history_window(C.collapse_user_turns(turns(spark, sf_dir)), 2).where(F.col("role") == "user")
    built = C.build_messages(F.lit("Be brief."), F.col("conv_id") % 2 == 0, F.col("history"), F.col("text"))
    return framed.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), built.alias("messages"))


@query
def build_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select(
        "request_id", F.size("messages").alias("n"), _spoken(F.col("messages")).alias("messages")
    )


@query
def sampling_params(spark, sf_dir):
    params = C.sampling_params(F.col("turn") % 2 == 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in params.items()])


@query
def request_rows(spark, sf_dir):
    even = F.substring_index("request_id", "-", -1).cast("bigint") % 2 == 0
    rows = C.request_rows(_messages(spark, sf_dir), even)

    def at(path):
        return F.get_json_object("request_json", path)

    return rows.select(
        "request_id",
        "temperature",
        at("$.top_p").cast("double").alias("top_p"),
        at("$.extra_body.top_k").cast("int").alias("top_k"),
        at("$.extra_body.repeat_penalty").cast("double").alias("repeat_penalty"),
        at("$.extra_body.chat_template_kwargs.enable_thinking").alias("enable_thinking"),
        at("$.messages[0].role").alias("first_role"),
        F.size("messages").alias("n"),
    )


@query
def running_concat(spark, sf_dir):
    return C.running_concat(tokens_of_answers(spark, sf_dir))


@query
def rollback_failed(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    failed = rows.where((F.col("role") == "assistant") & (F.length("text") % 2 == 0)).select("conv_id", "turn")
    return C.rollback_failed(rows, failed)


def _echo_client():
    """A deterministic stand-in for a model: says how many messages came and repeats the last."""

    def answer(document: str) -> str:
        messages = json.loads(document)["messages"]
        return f"{len(messages)}: {messages[-1]['content'][-1]['text']}"

    return answer


@query
def batch_generate_(spark, sf_dir):
    return batch_generate(C.request_rows(_messages(spark, sf_dir), F.lit(False)), _echo_client)


def _moody_client():
    """Repeats the last message, but refuses some."""
    echo = _echo_client()

    def answer(document: str) -> str:
        said = echo(document)
        if len(said) % 7 == 0:
            raise ValueError("refused")
        return said

    return answer


def open_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations up to their last user turn, which some leave blank."""
    rows = table(spark, sf_dir, "conversations")
    last = rows.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    blank = (F.col("turn") == F.col("_last")) & (F.col("conv_id") % 11 == 5)
    kept = rows.join(last, "conv_id").where("turn <= _last")
    return kept.select("conv_id", "turn", "role", F.when(blank, " \n ").otherwise(F.col("text")).alias("text"))


CHAT = ChatOptions(history_len=1, system_prompt="Be brief.", rag_mode=True)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns_ = open_conversations(spark, sf_dir)
    limits = SearchOptions(max_distance=0.6)
    kept = new_table_path(spark, "completions")
    answers = chat.chat_answers(spark, turns_, _moody_client, "moody", kept, CHAT, search=limits, collection=stored_documents(spark, sf_dir))
    return turns_, materialize(answers, "answers")


@query
def chat_answers(spark, sf_dir):
    """The open question of every conversation, answered from a collection of all documents."""
    return _answers(spark, sf_dir)[1]


@query
def chat_continued(spark, sf_dir):
    """The conversations after these answers."""
    return chat.continued(*_answers(spark, sf_dir))


# ---------------------------------------------------------------- inspection


@query
def preview_lines_(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("source_ord").alias("chunk_id"), "text")
    return preview_lines(docs, PreviewOptions(max_lines=200))


@query
def preview_all_lines(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("source_ord").alias("chunk_id"), "text")
    return preview_lines(docs, PreviewOptions(max_lines=-1))


@query
def line_count_(spark, sf_dir):
    return line_count(documents(spark, sf_dir))


# ---------------------------------------------------------------- streaming


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files, be it one file or a folder of them: only as a pattern may the path be either."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_ingest(spark, sf_dir):
    path, checkpoint = new_table_path(spark, "stream"), new_table_path(spark, "checkpoint")
    docs = _stream(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_ord"), "text"
    )
    ingest_stream(docs, T.text_elements(F.col("text"), LINE), path, checkpoint).awaitTermination()
    return latest_versions(spark, path).select(*CHUNKED)


@query
def stream_search(spark, sf_dir):
    """Questions against what a stream of documents has left."""
    path, checkpoint = new_table_path(spark, "stream"), new_table_path(spark, "checkpoint")
    docs = _stream(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("source_ord"), "text"
    )
    ingest_stream(docs, T.text_elements(F.col("text"), LINE), path, checkpoint).awaitTermination()
    hits = search_ingested(spark, path, questions(spark, sf_dir), SearchOptions(n_results=3, max_distance=0.6))
    return hits.select("query_id", "rank", "source_id", "chunk_ord", "distance", "text")


@query
def stream_prompts(spark, sf_dir):
    root, name = stored_documents(spark, sf_dir)
    path, checkpoint = new_table_path(spark, "stream"), new_table_path(spark, "checkpoint")
    asked = _stream(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    prompt_stream(spark, asked, root, name, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


@query
def stream_latest_turn(spark, sf_dir):
    """Newest user turn per conversation; later updates replace earlier ones."""
    path, checkpoint = new_table_path(spark, "stream"), new_table_path(spark, "checkpoint")
    latest = latest_user_turns(_stream(spark, sf_dir, "conversations"))
    writer = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(path)
    newest = F.max_by(F.struct("turn", "text"), "turn")
    return updates.groupBy("conv_id").agg(newest.alias("m")).select("conv_id", "m.turn", "m.text")
