"""Named collections as partitioned parquet tables under one root folder.

``chunks``   collection, version, segment, chunk_id, source_id, source_ord, chunk_ord, text, n_chars
``vectors``  collection, version, chunk_id, buckets, tf      or, with a model: embedding, error; with an index by cell
``cells``    collection, version, cell, n, radius, centre, space   (only with an index)
``terms``    collection, version, embedder, dim, n_chunks, idf   (one row per version; no idf with a model)

A collection is replaced by writing a new version beside the old one. Its row in ``terms`` is written last and makes it
the current version; a replacement that fails before that leaves the old one as it was. The version that was replaced
stays for readers that have begun, until the next replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.vectors import HASH_DIM
from askloom.operators.cells import nearest_in_cells, write_cells
from askloom.operators.embedding import Embedder, embed_texts, hash_embed, idf_table, term_counts, weigh
from askloom.operators.ordering import dense_layout, segment_of
from askloom.operators.search import nearest
from askloom.options import SearchOptions
from askloom.session import materialize

TABLES = ("chunks", "vectors", "cells", "terms")

# Writing tasks: one for so many chunks or per core, but not for fewer chunks than this, nor more tasks than this.
PART_ROWS = 131_072
LEAST_ROWS = 4_096
MOST_PARTS = 50_000
# Bound of the idf array, which every scoring task holds.
MOST_BUCKETS = 65_536


def _check_name(name: str) -> str:
    if not name or any(c in name for c in "/\\=:*?\"<>|{}%") or name.startswith("."):
        raise ValueError(f"not a usable collection name: {name!r}")
    return name


def _folder(spark: SparkSession, root: str, table: str, name: str):
    """File system and path of one collection's partition, on whatever storage ``root`` names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/collection={_check_name(name)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str, table: str, name: str, whole: bool = False) -> list[int]:
    """Version numbers that have a folder, rising; ``whole``: only those that hold a file."""
    fs, path = _folder(spark, root, table, name)
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("version=")]
    if whole:
        found = [p for p in found if any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p))]
    return sorted(int(p.getName().split("=")[1]) for p in found)


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The version that reads see: the highest one whose row in ``terms`` was written."""
    whole = _versions(spark, root, "terms", name, whole=True)
    return whole[-1] if whole else None


def collection_exists(spark: SparkSession, root: str, name: str) -> bool:
    return current_version(spark, root, name) is not None


def stored_names(spark: SparkSession, root: str) -> DataFrame:
    """``name`` of every collection under ``root``, from the partitions of the terms table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/terms")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string")
    # the schema is given so that names such as '007' stay strings
    terms = spark.read.schema("dim int, collection string, version int").parquet(f"{root}/terms")
    return terms.select(F.col("collection").alias("name")).distinct()


def collections_exist(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """Rows of ``names`` (``name``, others stay) with ``found``, whether that collection is stored; a null name is not."""
    stored = stored_names(spark, root).withColumn("_found", F.lit(True))
    return names.join(stored, "name", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def delete_collection(spark: SparkSession, root: str, name: str) -> None:
    """Remove the collection if it is there. ``terms`` goes first: without it nothing is readable."""
    for table in reversed(TABLES):
        fs, path = _folder(spark, root, table, name)
        fs.delete(path, True)


def _path(root: str, table: str, name: str, version: int) -> str:
    return f"{root}/{table}/collection={name}/version={version}"


def _drop_versions(spark: SparkSession, root: str, name: str, but: set[int]) -> None:
    """Remove what replaced versions and failed replacements left, ``terms`` first."""
    for table in reversed(TABLES):
        fs, path = _folder(spark, root, table, name)
        for version in set(_versions(spark, root, table, name)) - but:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"version={version}"), True)


def _laid_out(spark: SparkSession, chunks: DataFrame, total: int) -> DataFrame:
    """Chunks with ids, in partitions of consecutive ones, so that looking up a few ids reads a few segments."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-total // PART_ROWS))
    parts = max(1, min(wanted, -(-total // LEAST_ROWS), MOST_PARTS))
    return dense_layout(chunks, total, parts).withColumn("segment", segment_of(F.col("chunk_id")))


def _scan(spark: SparkSession, root: str, table: str, name: str) -> DataFrame:
    version = current_version(spark, root, _check_name(name))
    if version is None:
        raise ValueError(f"collection {name!r} does not exist")
    # names such as '123' must stay strings, whatever partition type inference would make of them
    return spark.read.parquet(_path(root, table, name, version)).withColumn("collection", F.lit(name))


def create_collection(
    spark: SparkSession,
    root: str,
    name: str,
    chunks: DataFrame,
    embedder: Embedder = Embedder(),
    dim: int = HASH_DIM,
    index: str | None = None,
) -> DataFrame:
    """Create or replace a collection from chunks; returns the stored chunks.

    ``index``: a distance (``cosine`` or ``l2``) for which the model's vectors are stored by cell (see ``operators.cells``).

    Until the new version is whole, the old one is what searches read. Replacements of one name must not overlap.
    The chunking result is written once before ids are given, so its plan runs once. Texts are then
    shuffled once, into files of consecutive ids. They are embedded in one more pass, map-only.
    """
    _check_name(name)
    if not 1 <= dim <= MOST_BUCKETS:
        raise ValueError(f"dim must lie between 1 and {MOST_BUCKETS}")
    if index and not embedder.factory:
        raise ValueError("an index needs the dense vectors of a model")
    staged = materialize(chunks, "chunks")
    total = staged.count()
    if total == 0:
        raise ValueError("no texts were extracted: the collection cannot be created")
    old = current_version(spark, root, name)
    version = 1 + max((v for table in TABLES for v in _versions(spark, root, table, name)), default=0)
    chunk_path, vector_path, cell_path, term_path = (_path(root, table, name, version) for table in TABLES)
    _laid_out(spark, staged, total).write.partitionBy("segment").parquet(chunk_path)
    stored = spark.read.parquet(chunk_path)
    if embedder.factory:
        vectors = embed_texts(stored, "chunk_id", embedder.factory, opts=embedder.opts)
    else:
        vectors = term_counts(stored, "chunk_id", dim=dim)
    if index:
        embedded = materialize(vectors, "vectors")
    else:
        vectors.write.parquet(vector_path)
        embedded = spark.read.parquet(vector_path)
    if embedder.factory:
        # the size that most vectors have; one of another size counts as an error of the model
        sizes = embedded.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
        usual = F.max_by(F.when(F.col("size") > 0, F.col("size")), F.when(F.col("size") > 0, F.struct("n", "size")))
        no_idf = F.lit(None).cast("array<double>").alias("idf")
        terms = sizes.agg(F.sum("n").alias("n_chunks"), F.coalesce(usual, F.lit(0)).alias("dim")).select("n_chunks", no_idf, "dim")
        if index:
            write_cells(embedded, vector_path, cell_path, dim=max(1, terms.select("dim").first()["dim"]), space=index)
    else:
        terms = idf_table(embedded, dim).withColumn("dim", F.lit(dim))
    terms.withColumn("embedder", F.lit(embedder.name)).coalesce(1).write.parquet(term_path)
    _drop_versions(spark, root, name, {version, old})
    return collection_chunks(spark, root, name)


def collection_chunks(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _scan(spark, root, "chunks", name)


def _vector_error(dim: int) -> Column:
    """What is wrong with a row's vector, if anything."""
    said = F.concat(F.lit("vector of "), F.size("embedding"), F.lit(f" numbers, not {dim}"))
    return F.coalesce(F.col("error"), F.when(F.coalesce(F.size("embedding") != dim, F.lit(True)), F.coalesce(said, F.lit("no vector"))))


def chunks_without_vector(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``chunk_id, source_id, error`` of the chunks that the collection's model failed on."""
    dim = _scan(spark, root, "terms", name).select("dim").first()["dim"]
    if index_space(spark, root, name):
        # an index keeps them all in one cell
        path = spark._jvm.org.apache.hadoop.fs.Path(_path(root, "vectors", name, current_version(spark, root, name)), "cell=-1")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        schema = "chunk_id bigint, embedding array<float>, error string"
        vectors = spark.read.schema(schema).parquet(path.toString()) if there else spark.createDataFrame([], schema)
    else:
        vectors = _scan(spark, root, "vectors", name)
    failed = vectors.select("chunk_id", _vector_error(dim).alias("error")).where("error IS NOT NULL")
    return failed.join(collection_chunks(spark, root, name).select("chunk_id", "source_id"), "chunk_id")


def collection_count(spark: SparkSession, root: str, name: str) -> DataFrame:
    return collection_chunks(spark, root, name).groupBy("collection").agg(F.count("*").alias("n_chunks"))


def retrieve_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Every chunk of the collection, the same for any question; ``chunk_id`` gives the order."""
    return collection_chunks(spark, root, name).select("chunk_id", "text")


def collection_terms(spark: SparkSession, root: str, name: str, embedder: Embedder = Embedder()) -> tuple[DataFrame, int]:
    """The collection's one row of terms and its vector size.

    Refuses an embedder other than the one the collection was built with.
    """
    terms = _scan(spark, root, "terms", name)
    built = terms.select("embedder", "dim").first()
    if built["embedder"] != embedder.name:
        raise ValueError(f"collection {name!r} was embedded with {built['embedder']!r}, not {embedder.name!r}")
    return terms, built["dim"]


def embed_questions(spark: SparkSession, root: str, name: str, questions: DataFrame, embedder: Embedder) -> DataFrame:
    """``query_id, embedding, error`` of questions for a collection with a model; an odd-sized vector is an error."""
    _, dim = collection_terms(spark, root, name, embedder)
    asked = embed_texts(questions, "query_id", embedder.factory, opts=embedder.opts)
    return asked.withColumn("error", _vector_error(dim))


def index_space(spark: SparkSession, root: str, name: str) -> str | None:
    """The distance of the collection's index, if there is one with any cell."""
    version = current_version(spark, root, name)
    if version not in _versions(spark, root, "cells", name, whole=True):
        return None
    row = _scan(spark, root, "cells", name).select("space").first()
    return row and row["space"]


def search_collection(
    spark: SparkSession,
    root: str,
    name: str,
    questions: DataFrame,
    opts: SearchOptions = SearchOptions(),
    embedder: Embedder = Embedder(),
) -> DataFrame:
    """Hits of many questions ``(query_id, text)`` in one collection, embedded as the chunks were.

    Questions that already have vectors (``embedding``, see :func:`embed_questions`) are not embedded again. A collection
    with an index for the distance asked for is searched through it, with equal results unless ``opts.approximate`` is set.
    """
    terms, dim = collection_terms(spark, root, name, embedder)
    version = current_version(spark, root, name)
    indexed = index_space(spark, root, name) == opts.space
    if opts.approximate and not indexed:
        raise ValueError(f"collection {name!r} has no index for {opts.space!r}")
    if embedder.factory:
        asked = questions if "embedding" in questions.columns else embed_questions(spark, root, name, questions, embedder)
        if indexed:
            return nearest_in_cells(spark, _path(root, "vectors", name, version), _path(root, "cells", name, version), asked, opts, dim=dim)
        return nearest(_scan(spark, root, "vectors", name), asked, opts, dim=dim)
    stored = _scan(spark, root, "vectors", name)
    idf_values = terms.select("idf").scalar()
    vectors = weigh(stored.select("chunk_id", "buckets", "tf"), "chunk_id", idf_values)
    return nearest(vectors, hash_embed(questions, "query_id", idf_values, dim=dim), opts, dim=dim)
