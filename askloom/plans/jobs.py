"""Whole jobs: documents to a collection, questions to prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.text import clean_elements, text_elements
from askloom.operators.chunking import chunk_documents
from askloom.operators.embedding import Embedder
from askloom.operators.prompting import check_template, contexts, not_blank, prompts, with_texts
from askloom.options import DEFAULT_CONTEXT_TEMPLATE, ChunkOptions, CleanOptions, SearchOptions
from askloom.session import materialize
from askloom.sources import collections
from askloom.sources.routing import ingest_log


# Hit rows (three numbers each) up to which the text lookup broadcasts them.
BROADCAST_HITS = 500_000


# Characters of one context, which is one string of one row. A question with a larger one gets the status
# ``too_large``; its ranked hit rows are of any number.
CONTEXT_CHARS = 256 * 1024 * 1024


def elements_in_rows(docs: DataFrame, elements: Column, clean: CleanOptions = CleanOptions()) -> DataFrame:
    """``(source_id, source_ord, elements)`` with cleaned elements."""
    return docs.select("source_id", "source_ord", clean_elements(elements, clean).alias("elements"))


def chunk_texts(
    docs: DataFrame,
    sep: str,
    clean: CleanOptions = CleanOptions(),
    chunk: ChunkOptions = ChunkOptions(),
) -> DataFrame:
    """Raw texts ``(source_id, source_ord, text)`` to chunks: split, clean, pack."""
    return chunk_documents(elements_in_rows(docs, text_elements(F.col("text"), sep), clean), chunk)


def build_collection(
    spark: SparkSession,
    root: str,
    name: str,
    docs: DataFrame,
    chunk: ChunkOptions = ChunkOptions(),
    sources: DataFrame | None = None,
    embedder: Embedder | None = Embedder(),
    index: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index sources with cleaned ``elements`` and report on each: ``(chunks, ingest log)``."""
    if embedder is None:
        raise ValueError("no embedder: the collection cannot be created")
    stored = collections.create_collection(spark, root, name, chunk_documents(docs, chunk), embedder, index=index)
    if sources is None:
        sources = docs.select(
            "source_id",
            F.col("source_id").alias("uri"),
            F.lit("loaded").alias("status"),
            F.lit(None).cast("string").alias("detail"),
        )
    failed = collections.chunks_without_vector(spark, root, name) if embedder.factory else None
    return stored, ingest_log(sources, stored, failed)


def rag_prompts(
    spark: SparkSession,
    root: str,
    name: str,
    questions: DataFrame,
    search: SearchOptions = SearchOptions(),
    template: str = DEFAULT_CONTEXT_TEMPLATE,
    embedder: Embedder = Embedder(),
) -> DataFrame:
    """Prompts for ``questions`` (query_id, text) from a stored collection: ``query_id, status, n_hits, context, prompt``.

    Status: ``answered``, ``blank``, ``no_context`` (nothing near enough), ``too_large`` (the context is beyond
    ``CONTEXT_CHARS``) or ``error`` (the model gave the question no usable vector).
    """
    check_template(template)
    asked = not_blank(questions)
    refused = None
    if search.n_results == "all":
        size = collections.collection_chunks(spark, root, name).agg(F.sum("n_chars")).first()[0]
        if size > CONTEXT_CHARS:
            nothing = asked.where("false").select("query_id", F.lit(0).alias("n_hits"), F.lit("").alias("context"))
            return prompts(questions, nothing, template, asked.select("query_id", F.lit("too_large").alias("reason")))
        whole = collections.retrieve_all(spark, root, name)
        one = contexts(whole.select(F.lit(0).alias("query_id"), F.lit(0.0).alias("distance"), "chunk_id", "text"))
        found = asked.select("query_id").withColumn("n_hits", one.select("n_hits").scalar()).withColumn(
            "context", one.select("context").scalar()
        )
    else:
        if embedder.factory:
            # asked once: both the search and the report of failures need the answer
            asked = materialize(collections.embed_questions(spark, root, name, asked, embedder), "asked")
            refused = asked.where("error IS NOT NULL").select("query_id", F.lit("error").alias("reason"))
        # written once: scoring is the costly step, and the size of its result decides the join
        hits = materialize(collections.search_collection(spark, root, name, asked, search, embedder), "hits")
        if search.k is None:
            lengths = collections.collection_chunks(spark, root, name).select("chunk_id", "n_chars")
            sizes = hits.join(lengths, "chunk_id").groupBy("query_id").agg(F.sum("n_chars").alias("n"))
            large = materialize(sizes.where(F.col("n") > CONTEXT_CHARS).select("query_id", F.lit("too_large").alias("reason")), "large")
            refused = large if refused is None else refused.unionByName(large)
            hits = hits.join(large, "query_id", "left_anti")
        if hits.count() <= BROADCAST_HITS:
            # with a filter on the broadcast side, only the segments of the hits are read
            hits = F.broadcast(hits.where(F.col("distance") <= search.max_distance))
        found = contexts(with_texts(hits, collections.collection_chunks(spark, root, name)))
    return prompts(questions, found, template, refused)
