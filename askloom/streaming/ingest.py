"""Incremental ingest and retrieval with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askloom.functions.text import clean_elements
from askloom.functions.vectors import count_buckets, tokens
from askloom.operators.chunking import chunk_documents
from askloom.operators.embedding import hash_embed, idf_table, weigh
from askloom.operators.ordering import assign_chunk_ids
from askloom.operators.search import nearest
from askloom.options import DEFAULT_CONTEXT_TEMPLATE, ChunkOptions, CleanOptions, SearchOptions
from askloom.plans.jobs import rag_prompts
from askloom.session import materialize


# Folder below the chunks that says which source arrived in which batch, with or without chunks.
ARRIVED = "_arrived"


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row per source of a batch: the one with the highest ``version``, if there is such a column, then ``source_ord``, then hash.

    Only sources that came more than once are shuffled.
    """
    twice = docs.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id")
    rank = [F.col(c) for c in ("version", "source_ord") if c in docs.columns]
    rank.append(F.xxhash64(*[F.col(c) for c in docs.columns if c != "source_id"]))
    rows = F.struct(*[F.col(c) for c in docs.columns if c != "source_id"])
    best = docs.join(twice, "source_id", "left_semi").groupBy("source_id").agg(F.max_by(rows, F.struct(*rank)).alias("m"))
    return docs.join(twice, "source_id", "left_anti").unionByName(best.select("source_id", "m.*"))


def stream_chunks(docs: DataFrame, elements: Column, clean: CleanOptions, chunk: ChunkOptions) -> DataFrame:
    """Embedded chunks of a batch of documents.

    Dense ids need the whole collection, so a search gives them; here a chunk is known by its source
    and place.
    """
    rows = docs.select("source_id", "source_ord", clean_elements(elements, clean).alias("elements"))
    chunks = chunk_documents(rows, chunk)
    counted = chunks.withColumn("_c", count_buckets()(tokens(F.col("text"))))
    return counted.select(*chunks.columns, "_c.buckets", "_c.tf")


def _write_batch(path: str):
    """Write each batch to its own partition: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def ingest_stream(
    docs: DataFrame,
    elements: Column,
    path: str,
    checkpoint: str,
    clean: CleanOptions = CleanOptions(),
    chunk: ChunkOptions = ChunkOptions(),
) -> StreamingQuery:
    """Chunk every document that has arrived and stop; run again for what arrives later.

    A source that arrives again, even without any text, replaces what it had.
    """
    write, note = _write_batch(path), _write_batch(f"{path}/{ARRIVED}")

    def ingest(batch: DataFrame, batch_id: int) -> None:
        write(stream_chunks(one_of_each(batch), elements, clean, chunk), batch_id)
        # last: until then the earlier versions stand
        note(batch.select("source_id").distinct(), batch_id)

    return (
        docs.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of each source as it arrived last: a source that comes again replaces itself."""
    newest = spark.read.parquet(f"{path}/{ARRIVED}").groupBy("source_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(path).join(newest, ["source_id", "batch_id"])


def search_ingested(
    spark: SparkSession, path: str, questions: DataFrame, opts: SearchOptions = SearchOptions()
) -> DataFrame:
    """Hits with texts in all that has been ingested so far; ids and document frequencies are as of now."""
    stored = latest_versions(spark, path)
    place = ["source_id", "source_ord", "chunk_ord"]
    known = materialize(assign_chunk_ids(stored.select(*place, "buckets", "tf")), "ingested")
    counts = known.select("chunk_id", "buckets", "tf")
    idf_values = materialize(idf_table(counts), "idf").select("idf").scalar()
    asked = hash_embed(questions, "query_id", idf_values)
    hits = materialize(nearest(weigh(counts, "chunk_id", idf_values), asked, opts), "hits")
    placed = hits.join(known.select("chunk_id", *place), "chunk_id")
    return placed.join(stored.select(*place, "text"), place)


def prompt_stream(
    spark: SparkSession,
    questions: DataFrame,
    root: str,
    name: str,
    path: str,
    checkpoint: str,
    search: SearchOptions = SearchOptions(),
    template: str = DEFAULT_CONTEXT_TEMPLATE,
) -> StreamingQuery:
    """Answer a stream of questions (query_id, text) from a stored collection."""
    write = _write_batch(path)

    def answer(batch: DataFrame, batch_id: int) -> None:
        write(rag_prompts(batch.sparkSession, root, name, batch, search, template), batch_id)

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
