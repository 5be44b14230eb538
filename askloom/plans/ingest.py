"""One ingest job: lists of files and URLs, each read by its type, to a collection and a log of every source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.text import BLANK_LINE, clean, clean_elements, html_elements, text_elements
from askloom.operators.chunking import chunk_documents, chunk_elements
from askloom.operators.embedding import Embedder
from askloom.operators.ordering import number_within
from askloom.options import ChunkOptions, CleanOptions
from askloom.session import few_listing_tasks, materialize
from askloom.sources import collections, files, routing, transcripts

ELEMENTS = "array<struct<category:string,text:string>>"
# Bytes of a file that is read into one row; CSV and TSV files are read by lines and have no limit.
MOST_BYTES = 512 * 1024 * 1024


@dataclass(frozen=True)
class Sources:
    """What to ingest. Tables that are not given are empty.

    ``files``: uri (a path below ``folder``), source_ord. ``urls``: url, source_ord. Both orders must be
    unique within their table; files come first. ``pages``: url, html of the pages that were fetched.
    ``transcripts``: video_id, lang, is_generated, seq, text.
    """

    folder: str | None = None
    files: DataFrame | None = None
    urls: DataFrame | None = None
    pages: DataFrame | None = None
    transcripts: DataFrame | None = None
    subtitle_lang: str = "ru"


def _or_empty(spark: SparkSession, df: DataFrame | None, schema: str) -> DataFrame:
    if df is None:
        return spark.createDataFrame([], schema)
    wanted = [c.split()[0] for c in schema.split(", ")]
    return df.select(*wanted)


def listed(spark: SparkSession, sources: Sources) -> DataFrame:
    """``source_id, source_ord, kind, uri, ext, status``: every entry of the lists in load order.

    ``kind`` is ``file``, ``page`` or ``video``. An entry that stands in a list twice is read twice.
    """
    paths = _or_empty(spark, sources.files, "uri string, source_ord bigint").select(
        F.lit("").alias("source_id"), "source_ord", F.lit("file").alias("kind"), "uri"
    )
    urls = _or_empty(spark, sources.urls, "url string, source_ord bigint")
    video = F.coalesce(F.contains("url", F.lit(routing.VIDEO_HOST)), F.lit(False))
    urls = urls.select(F.lit("").alias("source_id"), "source_ord", F.when(video, "video").otherwise("page").alias("kind"), F.col("url").alias("uri"))
    both = routing.union_sources(paths, urls).withColumn("source_id", F.col("source_ord").cast("string"))
    gated = routing.gate(both.withColumn("uri", F.coalesce("uri", F.lit(""))))
    bad_video = ~F.coalesce(routing.is_video_id(routing.video_id(F.col("uri"))), F.lit(False))
    status = (
        F.when(F.col("kind") == "file", F.col("status"))
        .when((F.col("kind") == "video") & bad_video, "invalid_url")
        .otherwise("loaded")
    )
    return gated.withColumn("status", status)


def _listed_files(spark: SparkSession, folder: str, kinds: tuple[str, ...], form: str) -> DataFrame:
    """Files with one of the extensions, at any depth, in a form of reader. The folder is listed here, once for all that is read."""
    each = ["*." + "".join(f"[{c}{c.upper()}]" for c in kind) for kind in kinds]
    reader = spark.read.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(each) + "}")
    with few_listing_tasks(spark):
        return reader.load(folder)


def _of_kind(found: DataFrame, *kinds: str) -> DataFrame:
    """Those of the listed files with one of the extensions: Spark leaves out the others by their names, unread."""
    return found.where(F.col("_metadata.file_name").rlike(rf"(?i)\.({'|'.join(kinds)})\z"))


def _below(spark: SparkSession, folder: str, path: Column) -> Column:
    """Path relative to ``folder``, whatever scheme and form the file system gives it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)
    return F.substring(F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?/*", "/"), len(full.toUri().getPath().rstrip("/")) + 2, 1 << 30)


def read_files(spark: SparkSession, sources: Sources, wanted: DataFrame, sep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files by type: ``(whole files with elements, CSV and TSV records, problems)``.

    Whole: source_id, source_ord, elements. Records: source_id, source_ord, elem_ord, category, text.
    Problems: source_id, detail, for files that are absent, too large or damaged.
    """
    folder, place = sources.folder, wanted.select("uri", "source_id", "source_ord")
    small = F.col("length") <= MOST_BYTES
    text = F.ltrim(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufeff"))
    there = _listed_files(spark, folder, routing.SUPPORTED_EXTENSIONS, "binaryFile")
    uri = _below(spark, folder, F.col("path")).alias("uri")
    plain = _of_kind(there, "txt", "md", "org").where(small).select(uri, text.alias("text"))
    ext = routing.extension(F.col("uri"))
    by_type = F.when(ext == "txt", text_elements(F.col("text"), sep))
    for kind in ("md", "org"):
        by_type = by_type.when(ext == kind, files.elements_of(kind, F.col("text")))
    html = _of_kind(there, "html").where(small).select(uri, html_elements(text).alias("elements"))
    content = _of_kind(there, *files.OFFICE_READERS).where(small).select(uri, "content")
    # parsed once: both its elements and its errors are asked for
    office = materialize(files.office_documents(content.select(F.col("uri").alias("source_id"), "content")).withColumnRenamed("source_id", "uri"), "office")
    whole = plain.select("uri", by_type.alias("elements")).unionByName(html).unionByName(office.where("error IS NULL").select("uri", "elements"))
    records, tables = None, _listed_files(spark, folder, ("csv", "tsv"), "text")
    for kind, cell in (("csv", ","), ("tsv", "\t")):
        found = files.record_elements(files.record_lines(_of_kind(tables, kind)), cell)
        found = found.withColumn("uri", _below(spark, folder, F.try_url_decode(F.replace(F.col("source_id"), F.lit("+"), F.lit("%2B"))))).drop("source_id")
        records = found if records is None else records.unionByName(found)
    large = ~ext.isin("csv", "tsv") & (F.col("length") > MOST_BYTES)
    lost = place.join(there.select(uri, "length"), "uri", "left").select(
        "source_id", F.when(F.col("length").isNull(), "no such file").when(large, "file is too large").alias("detail")
    )
    damaged = office.where("error IS NOT NULL").join(place, "uri").select("source_id", F.col("error").alias("detail"))
    return (
        whole.join(place, "uri").select("source_id", "source_ord", "elements"),
        records.join(place, "uri").select("source_id", "source_ord", "elem_ord", "category", "text"),
        lost.where("detail IS NOT NULL").unionByName(damaged),
    )


def ingest_sources(
    spark: SparkSession,
    root: str,
    name: str,
    sources: Sources,
    clean_opts: CleanOptions = CleanOptions(),
    chunk: ChunkOptions = ChunkOptions(),
    embedder: Embedder | None = Embedder(),
    sep: str = BLANK_LINE,
    index: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read, clean, chunk, embed and store all sources as one collection: ``(chunks, ingest log)``.

    Every entry of the lists has a row in the log: ``loaded`` or ``no_text``, else ``unsupported``, ``error``,
    ``invalid_url``, ``no_subtitles`` or ``lang_missing``. A bad source never stops the others; only a job that
    leaves no chunk at all is refused. Chunks of whole files and pages are packed where they are read; records and
    transcript lines, which may be any number per source, in blocks.
    """
    if embedder is None:
        raise ValueError("no embedder: the collection cannot be created")
    known = materialize(listed(spark, sources), "sources")
    good = known.where("status = 'loaded'")
    pages = _or_empty(spark, sources.pages, "url string, html string").groupBy("url").agg(F.max("html").alias("html"))
    asked = good.where("kind = 'page'").join(pages.withColumnRenamed("url", "uri"), "uri", "left")
    whole = asked.where("html IS NOT NULL").select("source_id", "source_ord", html_elements(F.col("html")).alias("elements"))
    problems = asked.where("html IS NULL").select("source_id", F.lit("page was not fetched").alias("detail"))

    lines = _or_empty(spark, sources.transcripts, "video_id string, lang string, is_generated boolean, seq bigint, text string")
    videos = good.where("kind = 'video'").select("source_id", "source_ord", routing.video_id(F.col("uri")).alias("video_id"))
    tracks = transcripts.transcript_status(videos, lines, sources.subtitle_lang)
    said = transcripts.transcript_elements(lines, sources.subtitle_lang).withColumnRenamed("source_id", "video_id")
    rows = videos.join(said, "video_id").select("source_id", "source_ord", "elem_ord", "category", "text")

    if sources.folder:
        documents, records, damaged = read_files(spark, sources, good.where("kind = 'file'"), sep)
        whole, rows, problems = documents.unionByName(whole), records.unionByName(rows), problems.unionByName(damaged)
    cleaned = rows.withColumn("text", clean(F.col("text"), clean_opts)).where(F.length("text") > 0)
    # written once: both the lengths and the texts of blocks are asked for
    numbered = materialize(number_within(cleaned, ["source_id", "source_ord"], "elem_ord"), "records")
    packed = whole.withColumn("elements", clean_elements(F.col("elements"), clean_opts))
    chunks = chunk_documents(packed, chunk).unionByName(chunk_elements(numbered, chunk))
    stored = collections.create_collection(spark, root, name, chunks, embedder, index=index)

    found = problems.groupBy("source_id").agg(F.min("detail").alias("_problem"))
    states = tracks.select("source_id", F.col("status").alias("_state"), F.col("detail").alias("_track"))
    status = known.join(found, "source_id", "left").join(states, "source_id", "left").select(
        "source_id",
        "uri",
        F.when(F.col("_problem").isNotNull(), "error").otherwise(F.coalesce("_state", "status")).alias("status"),
        F.coalesce("_problem", "_track").alias("detail"),
    )
    failed = collections.chunks_without_vector(spark, root, name) if embedder.factory else None
    return stored, routing.ingest_log(status, stored, failed)
