"""Removal of word passages that an earlier document already holds.

A window is ``WINDOW`` consecutive words of one text, known by two Rabin-Karp hashes modulo 2**64, of which
96 bits are kept. A word goes if a window over it also starts in a document with a smaller id.

To shuffle only windows that can repeat, equal windows are found by something smaller first. Each window
has an anchor, the smallest hash of its ``GRAM``-word grams; equal windows have equal anchors, and
neighbouring windows mostly share one, so a text has one anchor for about 20 words.

1. One row per text: its size, a 128-bit hash of its word sequence, its distinct anchors.
2. Texts with the same word sequence as a smaller document go whole, without any window.
3. Of the others, anchors that occur in several documents are found by grouped aggregation.
4. Texts with such anchors give the hashes of the windows that have one. The windows are counted in Spark by
   a second aggregation; those that start in a smaller document become removal intervals.
5. Overlapping intervals merge into maximal ones, and the texts are cut by them.

A very frequent passage is one key of partial aggregations and of joins that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.frames import binary_rows, packed, table
from askloom.llm.words import BASES, FACTORS, U, Rolling, Spelling, Words, mix, portions, powers
from askloom.session import materialize

WINDOW = 50
GRAM = 12
WHOLE = "doc_id bigint, tag bigint, n_words bigint, t1 bigint, t2 bigint, anchors binary"


def _anchors(words: Words, window: int, gram: int) -> np.ndarray:
    """For each place where ``window`` words follow in the whole array, the smallest gram hash there."""
    h = words.hashes
    factors = powers(FACTORS[1], gram + 1)[1:]
    n = max(0, len(h) - gram + 1)
    low = np.zeros(n, dtype=U)
    for k in range(gram):
        low += h[k : k + n] * factors[k]
    low = mix(low)
    span, have = window - gram + 1, 1  # a window holds so many grams
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _ranges(words: Words, window: int) -> Iterator[tuple[int, int, int]]:
    """(text, first window, end of windows) for the texts that have a window."""
    sizes = np.diff(words.bounds)
    for i in np.flatnonzero(sizes >= window):
        yield int(i), int(words.bounds[i]), int(words.bounds[i + 1]) - window + 1


def _digest(data: bytes) -> tuple[int, int]:
    """128 bits of a whole word sequence, whatever its length."""
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _describe(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling()
        for batch in portions(batches, "text"):
            words = Words(batch.column("text"), spelling=spelling)
            a, b = words.bounds[:-1], words.bounds[1:]
            raw = words.hashes.tobytes()
            totals = np.array([_digest(raw[8 * i : 8 * j]) for i, j in zip(a.tolist(), b.tolist())], dtype=np.int64).reshape(-1, 2).T
            low = _anchors(words, window, gram)
            parts, sizes = [], np.zeros(batch.num_rows + 1, dtype=np.int64)
            for i, first, last in _ranges(words, window):
                own = np.unique(low[first:last])
                parts.append(own)
                sizes[i + 1] = len(own)
            anchors = packed(np.concatenate(parts) if parts else np.empty(0, U), np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(b - a), *map(pa.array, totals), anchors],
                names=["doc_id", "tag", "n_words", "t1", "t2", "anchors"],
            )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, bounds = binary_rows(batch.column("anchors"), np.int64)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(values)],
            names=["doc_id", "tag", "anchor"],
        )


def _windows(window: int, gram: int):
    """Texts with their shared anchors to the hashes of the windows that have one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, hashes = Spelling(), [Rolling(b) for b in BASES]
        for batch in portions(batches, "text"):
            words = Words(batch.column("text"), spelling=spelling)
            low = _anchors(words, window, gram)
            shared = batch.column("shared")
            doc, tag = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            at, rows, places = [], [], []
            for i, first, last in _ranges(words, window):
                known = np.frombuffer(shared[i].as_buffer(), dtype=U)
                hit = np.flatnonzero(np.isin(low[first:last], known))
                at.append(first + hit)
                places.append(hit)
                rows.append(np.full(len(hit), i))
            if not at:
                continue
            at, rows, places = np.concatenate(at), np.concatenate(rows), np.concatenate(places)
            h1, h2 = (mix(r.stretch(r.prefix(words.hashes), at, at + window)) for r in hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)),
                    pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32)),
                    pa.array(doc[rows]),
                    pa.array(tag[rows]),
                    pa.array(places.astype(np.int32)),
                ],
                names=["h1", "h2", "doc_id", "tag", "place"],
            )

    return run


def _merge(window: int):
    """Places of removed windows of a text to the bounds of maximal intervals of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("places"):
                p = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.diff(p) > window)
                first = p[np.concatenate(([0], cut + 1))]
                last = p[np.concatenate((cut, [len(p) - 1]))] + window
                spans.append(np.stack([first, last], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(spans, pa.binary())],
                names=["doc_id", "tag", "spans"],
            )

    return run


def _joined(series: list) -> pa.Array:
    return pa.array(series, pa.binary())


def _cut(keep_rest: list[str]):
    """Texts with their intervals to ``n_words, n_removed, spans, text`` beside the columns ``keep_rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling()
        for batch in portions(batches, "text"):
            words = Words(batch.column("text"), spelling=spelling)
            removed = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            copied = batch.column("_copied").to_numpy(zero_copy_only=False).astype(bool)
            spans = batch.column("_gone").to_pylist()
            out, out_spans = [], []
            for i in range(batch.num_rows):
                a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                own = np.frombuffer(spans[i] or b"", dtype=np.int32).reshape(-1, 2)
                if copied[i]:
                    own = np.array([[0, b - a]], dtype=np.int32)
                gone = np.zeros(b - a, dtype=bool)
                for first, last in own:
                    gone[first:last] = True
                removed[i] = gone.sum()
                starts, ends = words.start[a:b][~gone], words.end[a:b][~gone]
                # stretches of kept words with one blank between are copied at once
                whole = np.flatnonzero((starts[1:] != ends[:-1] + 1) | (words.data[ends[:-1]] != 32))
                first, last = np.concatenate(([0], whole + 1)), np.concatenate((whole, [len(starts) - 1]))
                pieces = [] if not len(starts) else [words.data[x:y].tobytes() for x, y in zip(starts[first], ends[last])]
                out.append(b" ".join(pieces))
                out_spans.append(own.tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep_rest),
                    pa.array(np.diff(words.bounds)),
                    pa.array(removed[:n]),
                    _joined(out_spans),
                    _joined(out).cast(pa.string()),
                ],
                names=[*keep_rest, "_n_words", "_n_removed", "_spans", "_kept"],
            )

    return run


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Columns of ``docs`` (``doc_id``, ``text``) and ``_n_words``, ``_n_removed``, ``_spans``, ``_kept`` per row.

    ``_spans`` packs the maximal removal intervals as pairs of int32 (first word, end); ``_kept`` holds
    the remaining words joined by one blank. A null text has no words. Repeated rows are all returned
    and never remove one another, since only a smaller ``doc_id`` counts; rows without an id neither
    lose words nor make others lose any. An empty table gives no rows. Columns may have any names but
    those four, ``_tag``, ``_id``, ``_of``, ``_gone`` and ``_copied``.
    """
    tagged = docs.withColumn("_tag", F.xxhash64("text"))
    keyed = tagged.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_tag").alias("tag"), "text")
    known = keyed.where("doc_id is not null")
    texts = materialize(known.mapInArrow(_describe(window, gram), WHOLE), "texts")
    long = texts.where(F.col("n_words") >= window)
    klass = ["n_words", "t1", "t2"]
    first = long.groupBy(*klass).agg(F.min("doc_id").alias("first"))
    judged = long.join(first, klass)
    copies = judged.where("doc_id > first").select("doc_id", "tag").distinct().withColumn("copied", F.lit(True))
    originals = judged.where("doc_id = first").select("doc_id", "tag", "anchors").distinct()
    rows = originals.mapInArrow(_unpack, "doc_id bigint, tag bigint, anchor bigint")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    mine = rows.join(shared.select("anchor"), "anchor", "left_semi").groupBy("doc_id", "tag")
    mine = mine.agg(F.collect_list("anchor").alias("list"))  # at most as long as the text
    mine = mine.mapInArrow(_pack, "doc_id bigint, tag bigint, shared binary")
    hashed = known.join(mine, ["doc_id", "tag"]).mapInArrow(
        _windows(window, gram), "h1 bigint, h2 int, doc_id bigint, tag bigint, place int"
    )
    hashed = materialize(hashed, "windows")
    count = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = hashed.join(count.drop("hi"), ["h1", "h2"]).where("doc_id > lo")
    places = later.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places"))
    spans = places.mapInArrow(_merge(window), "doc_id bigint, tag bigint, spans binary")
    gone = spans.withColumn("copied", F.lit(False)).unionByName(
        copies.withColumn("spans", F.lit(None).cast("binary"))
    )
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_of"), F.col("spans").alias("_gone"), F.col("copied").alias("_copied"))
    cut = tagged.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_tag") == F.col("_of")), "left")
    cut = cut.withColumn("_copied", F.coalesce("_copied", F.lit(False))).drop("_id", "_of", "_tag")
    added = T.StructType.fromDDL("_n_words bigint, _n_removed bigint, _spans binary, _kept string")
    return cut.mapInArrow(_cut(docs.columns), T.StructType([*docs.schema.fields, *added.fields]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("list")
        values = lists.flatten().to_numpy().view(U)
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), packed(values, bounds)], names=["doc_id", "tag", "shared"]
        )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; texts that lose nothing stay as they are."""
    found = removals(docs)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return found.select(
        *[
            text.alias(c) if c == "text" else F.length(text).cast(t).alias(c) if c == "n_chars" else F.col(c)
            for c, t in docs.dtypes
        ]
    )
