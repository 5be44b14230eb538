"""Video transcripts: choose a track, report what was found, join its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.options import check_subtitle_lang
from askloom.schemas import NARRATIVE


def chosen_track(transcripts: DataFrame, lang: str) -> DataFrame:
    """Per video with the asked language: is the manual track missing, so the automatic one is used?"""
    asked = transcripts.where(F.col("lang") == check_subtitle_lang(lang))
    return asked.groupBy("video_id").agg(F.min("is_generated").alias("is_generated"))


def transcript_text(transcripts: DataFrame, lang: str) -> DataFrame:
    """``(video_id, is_generated, text)``: lines of the manual track, else of the automatic one."""
    track = chosen_track(transcripts, lang)
    asked = transcripts.where(F.col("lang") == lang).join(track, ["video_id", "is_generated"], "left_semi")
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return asked.groupBy("video_id", "is_generated").agg(F.array_join(lines["text"], "\n").alias("text"))


def transcript_elements(transcripts: DataFrame, lang: str) -> DataFrame:
    """The chosen track as one element per line, for tracks too long to hold in one row.

    ``seq`` must count 0..n-1 within a track.
    """
    asked = transcripts.where(F.col("lang") == lang)
    track = chosen_track(transcripts, lang)
    return asked.join(track, ["video_id", "is_generated"], "left_semi").select(
        F.col("video_id").alias("source_id"),
        F.col("seq").alias("elem_ord"),
        F.lit(NARRATIVE).alias("category"),
        "text",
    )


def transcript_status(videos: DataFrame, transcripts: DataFrame, lang: str) -> DataFrame:
    """Per asked video: ``loaded`` (with the kind of track), ``lang_missing``, ``no_subtitles``."""
    check_subtitle_lang(lang)
    known = transcripts.groupBy("video_id").agg(
        F.min(F.when(F.col("lang") == lang, F.col("is_generated").cast("int"))).alias("_track")
    )
    joined = videos.join(known.withColumn("_known", F.lit(True)), "video_id", "left")
    return joined.select(
        *videos.columns,
        F.when(F.col("_known").isNull(), "no_subtitles")
        .when(F.col("_track").isNull(), "lang_missing")
        .otherwise("loaded")
        .alias("status"),
        F.when(F.col("_track") == 0, "manual").when(F.col("_track") == 1, "automatic").alias("detail"),
    )
