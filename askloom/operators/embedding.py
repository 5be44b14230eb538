"""Texts to vectors: the built-in hashed tf-idf embedder and the surface for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.vectors import HASH_DIM, count_buckets, idf, tokens
from askloom.options import EmbedOptions

HASHED = "hashed-tfidf"


def term_counts(texts: DataFrame, key: str, text: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """``(key, buckets, tf)`` per text: map-only, no row per token."""
    counted = count_buckets(dim)(tokens(F.col(text)))
    return texts.select(key, counted.alias("_c")).select(key, "_c.buckets", "_c.tf")


def idf_table(counts: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """One row with the array of ``dim`` idf values of a collection and its number of chunks.

    The number of texts rides along as bucket -1, so one pass yields both. The groups are at most
    ``dim + 1``, summed map-side first; the array is bounded by ``dim`` whatever the corpus size.
    """
    seen = counts.select(F.explode_outer(F.concat(F.array(F.lit(-1)), F.col("buckets"))).alias("bucket"))
    df = seen.groupBy("bucket").agg(F.count("*").alias("df"))
    slots = df.sparkSession.range(-1, dim).select(F.col("id").cast("int").alias("bucket"))
    full = slots.join(df, "bucket", "left").select("bucket", F.coalesce("df", F.lit(0)).alias("df"))
    ordered = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "df"))).alias("s"))
    counts_ = ordered.select(F.col("s")[0]["df"].alias("n_chunks"), F.expr("slice(s, 2, size(s) - 1)").alias("s"))
    return counts_.select(
        "n_chunks",
        F.transform("s", lambda x: idf(F.col("n_chunks"), x["df"])).alias("idf"),
    )


def weigh(counts: DataFrame, key: str, idf_values: Column) -> DataFrame:
    """``(key, buckets, weights)``: tf times the idf of the collection."""
    return counts.withColumn("_idf", idf_values).select(
        key,
        "buckets",
        F.zip_with(
            "buckets", "tf", lambda b, n: n * F.element_at(F.col("_idf"), b + 1)
        ).alias("weights"),
    )


def hash_embed(
    texts: DataFrame, key: str, idf_values: Column, text: str = "text", dim: int = HASH_DIM
) -> DataFrame:
    """Sparse tf-idf vectors of texts under a collection's idf; serves chunks and questions alike."""
    return weigh(term_counts(texts, key, text, dim), key, idf_values)


ModelFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


@dataclass(frozen=True)
class Embedder:
    """A name, kept with each collection, and the model behind it; no model means hashed tf-idf."""

    name: str = HASHED
    factory: ModelFactory | None = None
    opts: EmbedOptions = EmbedOptions()


def embed_texts(
    texts: DataFrame, key: str, factory: ModelFactory, text: str = "text", opts: EmbedOptions = EmbedOptions()
) -> DataFrame:
    """``(key, embedding, error)`` from a user-supplied model.

    ``factory`` runs once per task and returns the model; the model gets slices of ``batch_size``
    texts. A failing slice is repeated text by text, so an error stays with its own row.
    """
    batch_size, unit = opts.batch_size, bool(opts.normalize_embeddings)
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()

        def scaled(vector: Sequence[float]) -> list[float]:
            v = np.asarray(vector, dtype=np.float64)
            length = np.linalg.norm(v) if unit else 0
            return (v / length if length > 0 else v).tolist()

        def attempt(part: list[str]) -> list[tuple]:
            try:
                vectors = [scaled(v) for v in model(part)]
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                return [(v, None) for v in vectors]
            except Exception as problem:  # noqa: BLE001 - the model is user code
                if len(part) == 1:
                    return [(None, f"{type(problem).__name__}: {problem}")]
                return [done for one in part for done in attempt([one])]

        for batch in batches:
            values = batch.column(1).to_pylist()
            done = []
            for at in range(0, len(values), batch_size):
                done.extend(attempt(values[at : at + batch_size]))
            vectors = pa.array([d[0] for d in done], pa.list_(pa.float32()))
            errors = pa.array([d[1] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, errors], ["key", "embedding", "error"])

    schema = f"{key} {key_type}, embedding array<float>, error string"
    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
