"""Which source goes where: extension gate, URL lists, video ids, union of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extensions that are read; anything else is reported as unsupported.
SUPPORTED_EXTENSIONS = ("csv", "tsv", "docx", "md", "org", "pptx", "xlsx", "html", "txt")
VIDEO_HOST = "youtube.com"
VIDEO_ID_LENGTH = 11


def extension(uri: Column) -> Column:
    """Lower-case part after the last dot of the last path step; empty if there is none."""
    return F.lower(F.regexp_extract(uri, r"\.([^./]+)\z", 1))


def gate(sources: DataFrame, uri: str = "uri") -> DataFrame:
    """Add ``ext`` and ``status``: ``loaded`` for readable extensions, else ``unsupported``."""
    ext = extension(F.col(uri))
    return sources.withColumn("ext", ext).withColumn(
        "status", F.when(ext.isin(*SUPPORTED_EXTENSIONS), "loaded").otherwise("unsupported")
    )


def url_list(rows: DataFrame, key: str, urls: str = "urls") -> DataFrame:
    """One row per URL of a white-space separated list, in list order, with its route."""
    parts = F.filter(F.split(F.col(urls), r"\s+"), lambda u: F.length(u) > 0)
    listed = rows.select(key, F.posexplode_outer(parts).alias("url_ord", "url")).where(F.col("url").isNotNull())
    return listed.withColumn(
        "route", F.when(F.contains("url", F.lit(VIDEO_HOST)), "video").otherwise("page")
    )


def video_id(url: Column) -> Column:
    """Id part of a video URL: after ``watch?v=`` or ``live/``, up to ``&``."""

    def last(c: Column, marker: str) -> Column:
        return F.element_at(F.split(c, marker), -1)

    def first(c: Column, marker: str) -> Column:
        return F.element_at(F.split(c, marker), 1)

    return first(last(first(last(url, r"watch\?v="), "&"), "live/"), "&")


def is_video_id(candidate: Column) -> Column:
    return F.length(candidate) == VIDEO_ID_LENGTH


def url_status(listed: DataFrame) -> DataFrame:
    """Add ``status`` to routed URLs: a video URL without a usable video id is ``invalid_url``."""
    bad = (F.col("route") == "video") & ~F.coalesce(is_video_id(video_id(F.col("url"))), F.lit(False))
    return listed.withColumn("status", F.when(bad, "invalid_url").otherwise("loaded"))


def union_sources(files: DataFrame, urls: DataFrame) -> DataFrame:
    """Files first, then URLs, each in its own order; ``source_ord`` stays unique and ordered."""
    columns = ("source_id", "source_ord", "kind", "uri")
    shift = files.select((F.coalesce(F.max("source_ord"), F.lit(-1)) + 1).alias("n")).scalar()
    later = urls.withColumn("source_ord", F.col("source_ord") + shift)
    return files.select(*columns).unionByName(later.select(*columns))


def ingest_log(sources: DataFrame, chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per source: its status and number of chunks. A readable source without chunks is ``no_text``.

    ``sources``: source_id, uri, status, detail. Chunks are counted map-side before the join. ``failed``:
    source_id of each chunk that the model gave no vector for; such a source is an ``error``, and
    its detail says how many of its chunks no search can find.
    """
    if failed is not None:
        lost = failed.groupBy("source_id").agg(F.count("*").alias("_lost"))
        said = F.concat(F.col("_lost").cast("string"), F.lit(" chunks without a vector"))
        hit = (F.col("status") == "loaded") & F.col("_lost").isNotNull()
        log = ingest_log(sources, chunks).join(lost, "source_id", "left")
        log = log.withColumn("detail", F.when(hit, said).otherwise(F.col("detail")))
        return log.withColumn("status", F.when(hit, "error").otherwise(F.col("status"))).drop("_lost")
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    joined = sources.join(counts, "source_id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "source_id",
        "uri",
        F.when((F.col("status") == "loaded") & (n == 0), "no_text").otherwise(F.col("status")).alias("status"),
        "detail",
        F.when(F.col("status") == "loaded", n).otherwise(0).cast("bigint").alias("n_chunks"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(
        F.count("*").alias("n_sources"), F.sum("n_chunks").alias("n_chunks")
    )
