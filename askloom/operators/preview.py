"""Looking at loaded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import render
from askloom.options import PreviewOptions


def _lines(chunks: DataFrame) -> DataFrame:
    lines = F.posexplode_outer(F.split(render(F.col("text")), "\n", -1)).alias("line_no", "line")
    return chunks.select("chunk_id", lines)


def preview_lines(chunks: DataFrame, opts: PreviewOptions = PreviewOptions()) -> DataFrame:
    """First lines of the rendered texts in load order; a negative number gives all of them.

    Every chunk gives at least two lines, so the chunks are cut before their lines are made.
    """
    if opts.max_lines < 0:
        return _lines(chunks)
    first = chunks.select("chunk_id", "text").orderBy("chunk_id").limit(opts.max_lines)
    return _lines(first).orderBy("chunk_id", "line_no").limit(opts.max_lines)


def line_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.sum(F.size(F.split(render(F.col("text")), "\n", -1))).cast("bigint").alias("n_lines"))
