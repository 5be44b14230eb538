"""Quality classifier: gradient-boosted trees on histograms over statistics of whole texts.

The statistics are one map over the documents. The trees are fitted with numpy on a bounded sample of
labelled rows, their splits found on histograms of the binned statistics, and flattened into arrays;
scoring walks all rows of a batch down all trees by numpy indexing, a step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.frames import binary_rows, packed, table
from askloom.llm.words import U, Words, portions
from askloom.session import materialize

# Most labelled rows that a classifier is fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 60_000
TREES = 120
DEPTH = 5
BINS = 64
RATE = 0.15
LEAST_ROWS = 10
PENALTY = 1.0
ACCEPT = 0.3

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper",
    "digits",
    "blanks",
    "high_bytes",
    "bars",
    "bangs",
    "marks",
    "symbols",
    "line_breaks",
    "stops",
    "commas",
    "distinct",
    "repeats",
    "pairs",
    "top_word",
    "capital_words",
    "symbol_ends",
    "stop_ends",
    "mark_words",
    "short_words",
    "long_words",
    "line_bytes",
    "same_lines",
    "entropy",
)


def _class(chars: str | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


LETTERS = _class(range(65, 91)) | _class(range(97, 123)) | _class(range(128, 256))
SYMBOLS = _class("#$%&*@^_~+=<>\\`{}[]")
CLASSES = {
    "upper": _class(range(65, 91)),
    "digits": _class("0123456789"),
    "blanks": _class(" \t"),
    "high_bytes": _class(range(128, 256)),
    "bars": _class("|"),
    "bangs": _class("!?"),
    "marks": _class("/:;-()\"'"),
    "symbols": SYMBOLS,
    "line_breaks": _class("\n\r"),
    "stops": _class("."),
    "commas": _class(","),
}


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text, from its whole bytes; null and empty texts give zeros."""
    words = Words(texts)
    n = len(texts)
    large = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + n + 1]
    data, offsets = words.data[offsets[0] : offsets[-1]], offsets - offsets[0]
    base = int(np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset])
    size, count = np.diff(offsets), np.diff(words.bounds)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    out: dict[str, np.ndarray] = {"log_bytes": np.log1p(size), "log_words": np.log1p(count)}
    out["word_bytes"] = (size - 0.0) * per_word
    for name, flags in CLASSES.items():
        out[name] = _sums(flags[data], offsets) * per_byte
    letters = _sums(LETTERS[data], offsets)
    out["upper"] = out["upper"] * size / np.maximum(letters, 1)
    text_of = np.repeat(np.arange(n), count)
    order = np.lexsort((words.hashes, text_of))
    h, t = words.hashes[order], text_of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    out["distinct"] = np.bincount(t[new], minlength=n) * per_word
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, t[starts], runs)
    out["top_word"] = top * per_word
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    out["repeats"] = _sums(same, words.bounds) * per_word
    apart = np.zeros(len(h), dtype=bool)
    apart[2:] = (words.hashes[2:] == words.hashes[:-2]) & (text_of[2:] == text_of[:-2])
    out["pairs"] = _sums(apart, words.bounds) * per_word
    first, last, length = words.data[words.start], words.data[words.end - 1], words.end - words.start
    flags = {
        "capital_words": CLASSES["upper"][first],
        "symbol_ends": (SYMBOLS | CLASSES["bangs"])[last],
        "stop_ends": CLASSES["stops"][last],
        "mark_words": ~LETTERS[first] & ~LETTERS[last],
        "short_words": length <= 3,
        "long_words": length >= 14,
    }
    for name, values in flags.items():
        out[name] = _sums(values, words.bounds) * per_word
    lines = out["line_breaks"] * size + (size > 0)
    out["line_bytes"] = np.log1p(size / np.maximum(lines, 1))
    # words that begin a line, repeated with the two words after them
    begins = np.zeros(len(h), dtype=bool)
    if len(h):
        before = np.maximum(words.start - base - 1, 0)
        begins = CLASSES["line_breaks"][data[before]]
        begins[words.bounds[:-1][count > 0]] = True
    at = np.flatnonzero(begins)
    follow = np.minimum(at + 1, max(len(h) - 1, 0))
    key = words.hashes[at] * U(3) + words.hashes[follow] if len(at) else words.hashes[:0]
    o = np.lexsort((key, text_of[at]))
    k, kt = key[o], text_of[at][o]
    again = np.zeros(len(k), dtype=bool)
    again[1:] = (k[1:] == k[:-1]) & (kt[1:] == kt[:-1])
    out["same_lines"] = np.bincount(kt[again], minlength=n) / np.maximum(np.bincount(kt, minlength=n), 1)
    entropy = np.zeros(n)
    for i in range(n):
        seen = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        p = seen[seen > 0] / max(size[i], 1)
        entropy[i] = -(p * np.log2(p)).sum()
    out["entropy"] = entropy
    return np.stack([out[s] for s in STATISTICS], axis=1).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth as flat arrays: row t holds tree t, node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += self.rate * value[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Gradient boosting of the logistic loss, level by level, on histograms of ``BINS`` bins.

    Without rows the score is one half; with one label only, it is near that label everywhere.
    """
    n, m = x.shape if len(x) else (0, len(STATISTICS))
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1)
    empty = Forest(
        np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)),
        float(np.log(share / (1 - share))), rate,
    )
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS).astype(np.float32)) for j in range(m)]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = bins + np.arange(m) * BINS
    features, thresholds, values = [], [], []
    margin = np.full(n, empty.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        split_bin = np.full(inner, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            place = ((node - (width - 1))[:, None] * (m * BINS) + flat).reshape(-1)
            size = width * m * BINS
            shape = (width, m, BINS)
            g = np.bincount(place, np.repeat(grad, m), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(hess, m), size).reshape(shape).cumsum(axis=2)
            c = np.bincount(place, minlength=size).reshape(shape).cumsum(axis=2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (gt - g) ** 2 / (ht - h + PENALTY) - gt**2 / (ht + PENALTY)
            gain = np.where((c >= LEAST_ROWS) & (ct - c >= LEAST_ROWS), gain, -1.0)
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    k = width - 1 + i
                    feature[k], threshold[k], split_bin[k] = j, cuts[j][b], b
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > split_bin[node])
        leaf = node - inner
        value = np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + PENALTY)
        margin += rate * value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), empty.base, rate)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        x = statistics(batch.column("text"))
        bounds = np.arange(len(x) + 1) * x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), packed(x.reshape(-1), bounds)], names=["doc_id", "x"]
        )


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the packed statistics of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _statistics_of, "doc_id bigint, x binary"
    )


def remainder(doc_id):
    """crc32 of the id's decimal text modulo 5; rows with 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, y`` of the labelled rows that are not held out, at most ``rows``, chosen by a hash of their id.

    Labels other than 0 and 1 and null ids take no part; repeated labels of one document count once, the smallest label.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    usable = usable.where((remainder("doc_id") != 0) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(features: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on the rows of :func:`training_labels`; those without a document take no part."""
    sample = training_labels(labels, rows)
    found = features.join(sample, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = found.select("x", "y").toArrow()
    x, _ = binary_rows(got.column("x"), np.float32)
    return fit(x.reshape(-1, len(STATISTICS)), got.column("y").to_numpy().astype(float))


def _scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = binary_rows(batch.column("x"), np.float32)
            score = forest.score(x.reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def scored(features: DataFrame, forest: Forest) -> DataFrame:
    return features.mapInArrow(_scores(forest), "doc_id bigint, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored; null and empty texts get a score like any other."""
    features = materialize(described(table(spark, sf_dir, "documents")), "statistics")
    out = scored(features, train(features, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (remainder("doc_id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on their labels, gives a score of 0.3 or more.

    Statistics for the fit are computed of the texts in its bounded sample alone. Null and empty texts are scored like
    any other, repeated rows stay or go together, all columns stay as they are, whatever their names.
    """
    # at most SAMPLE_ROWS ids
    sampled = F.broadcast(training_labels(labels).select(F.col("doc_id").alias("_sampled")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    forest = train(described(texts.join(sampled, F.col("doc_id") == F.col("_sampled"), "left_semi")), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            good = forest.score(statistics(batch.column("text"))) >= ACCEPT
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(good))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
