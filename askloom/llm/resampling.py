"""Importance resampling: draw the documents whose word runs look most like a target set.

Features of a text are all runs of one to ``RUN`` consecutive words, joined by a blank, repeats counted; a
feature falls into bucket ``crc32(its bytes) mod BUCKETS``. The gain of a bucket is the logarithm, times 1,000
and rounded down, of its smoothed share among the target's features over that among all documents'. The
weight of a document is the sum of the gains of its features. A draw without replacement takes the highest
sums of weight and a Gumbel number hashed from the id, so a rerun of a lost task draws the same documents.

How it runs
-----------
1. One map hashes the features. Per slice of texts, distinct runs are found as numbers of dictionary codes and
   written out once; runs of equal length in bytes form a matrix of ``uint8``, and the checksums of all its
   rows advance together, column by column. The checksums are scattered back to the occurrences. The buckets of
   each row are kept as two bytes a feature, so nothing is hashed twice.
2. Counts per bucket are added up: at most ``BUCKETS`` rows from each task, ``BUCKETS`` in all.
3. One more map adds up gains; the table of gains has a fixed size.
4. Ranks: rows without texts, range-partitioned by their order, numbered within their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.blocks import byte_class, spelled
from askloom.llm.frames import binary_rows, packed, table
from askloom.llm.words import portions
from askloom.session import materialize

RUN = 3
BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
# Bytes of text hashed at a time, and of one matrix.
SLICE = 4 << 20
MATRIX = 8 << 20
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# Fixed value: the reversed polynomial of the checksum.
POLYNOMIAL = 0xEDB88320
HASHED = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"


def _steps() -> np.ndarray:
    """What each value of the low byte does to the rest of the checksum."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out.astype(np.uint32)


STEPS = _steps()


def checksums(texts: pa.Array) -> np.ndarray:
    """crc32 of each value of a large_binary array."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    out = np.empty(len(texts), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:])):
        step = max(1, MATRIX // max(1, length))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            # columns first, so that one column of all rows lies together
            matrix = data[ends[some][None, :] + np.arange(length)[:, None]] if len(some) > 1 else data[ends[some[0]] : ends[some[0]] + length][:, None]
            crc = np.full(len(some), 0xFFFFFFFF, dtype=np.uint32)
            for column in matrix:
                crc = STEPS[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[some] = ~crc
    return out


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, with their bounds, and the number of words per text."""
    codes, words, bounds = spelled(texts, WORD)
    n_words = np.diff(bounds)
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], n_words)
    text = np.repeat(np.arange(len(n_words)), n_words)
    found, owners = [], []
    key, ends = codes, np.arange(len(codes))
    run = words
    for n in range(1, RUN + 1):
        if n > 1:
            # runs of n words that end at a word: a run of n - 1 words that ends one word before, and that word
            longer = place[ends] + 1 < n_words[text[ends]]
            pairs = key[longer] * len(words) + codes[ends[longer] + 1]
            ends = ends[longer] + 1
            distinct, key = np.unique(pairs, return_inverse=True)
            before, last = distinct // max(1, len(words)), distinct % max(1, len(words))
            run = pc.binary_join_element_wise(run.take(pa.array(before)), words.take(pa.array(last)), pa.scalar(b" ", pa.large_binary()))
        found.append((checksums(run) % np.uint32(BUCKETS)).astype(np.uint16)[key])
        owners.append(text[ends])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=len(n_words))
    return np.concatenate(found)[order], np.concatenate(([0], np.cumsum(sizes))), n_words


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", SLICE):
        values, bounds, n_words = buckets(batch.column("text"))
        columns = [batch.column("doc_id"), pa.array(n_words), pa.array(np.diff(bounds)), packed(values, bounds)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])


def hashed(texts: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_features`` and the packed buckets of every row."""
    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_hash, HASHED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(binary_rows(batch.column("buckets"), np.uint16)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Number of features in each bucket: at most ``BUCKETS`` rows reach the driver."""
    got = features.select("buckets").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Gain of each bucket, from its count among the target's features and among all documents'."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = binary_rows(batch.column("buckets"), np.uint16)
            total = np.concatenate(([0], np.cumsum(gain[values])))
            weight = pa.array(total[bounds[1:]] - total[bounds[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], names=[*batch.schema.names[:3], "weight"])

    return features.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number times 1,000, rounded down, from a hash of the seed and the id; a null id is written ``null``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``_nth`` (from 1) in the given order: sorted ranges, numbered within, after the counts of those before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(bases), "_range").withColumn("_nth", F.col("_base") + inside + 1).drop("_range", "_at", "_base")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, n_features, weight, score, rank``.

    ``target`` has a column ``text``. Of the rows with ``least_words`` words or more, ``percent`` per cent (rounded
    down) are drawn; others have a null rank. Ties go to the smaller id, a null id last, then to the smaller weight and
    number of features. Null, empty and wordless texts have no feature and weight 0; repeated rows are drawn each; very
    long texts are hashed whole, in matrices of bounded size; empty tables give no rows, or gains that only
    smoothing decides; other columns may have any name.
    """
    features = materialize(hashed(docs), "features")
    wanted = bucket_counts(hashed(target.select(F.lit(0).alias("doc_id"), "text")))
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    rows = weighed(features, gains(wanted, bucket_counts(features))).withColumn("score", score)
    fit = F.col("n_words") >= least_words
    numbered = _numbered(rows.withColumn("_fit", fit), [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")])
    drawn = features.where(fit).agg(F.floor(F.count("*") * percent / 100).alias("n")).first()["n"]
    rank = F.when(F.col("_fit") & (F.col("_nth") <= drawn), F.col("_nth"))
    return numbered.withColumn("rank", rank.cast("bigint")).drop("_fit", "_nth")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
