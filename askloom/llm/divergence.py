"""Divergence audit: how far the words of each source of a language are from those of the others.

Per language, the vocabulary is the terms that at least ``LEAST_DOCUMENTS`` of its documents hold. A group (the
documents of one language and source, or of the whole language) gives each term the share
``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``. Two shares p and q differ by
``floor((p - q) ** 2 / (p + q))``. All arithmetic is on whole numbers.

How it runs
-----------
1. Portions of the corpus count their terms per group and, per language, the documents with a term. Each sends one
   row of packed arrays to each slice of the vocabulary (by a hash of the term), which adds them up. A frequent
   term, a large language or a large source costs one entry per portion.
2. A slice keeps the terms that enough documents hold. It puts terms of equal counts side by side (sorted by the
   counts in the largest groups) and stores each group's counts as runs of equal ones.
3. Each pair of groups of a language is compared slice by slice: the bounds of both columns' runs cut the slice into
   stretches in which both counts are constant, so the difference is computed once per stretch and multiplied by
   its length. Groups are dealt into blocks, so that a task holds the columns of two blocks of one slice.
4. Sums over slices give the pairs; the highest terms of each slice, at most ``TERMS`` per group, give the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.blocks import (
    byte_class,
    dealt,
    part_of,
    spelled,
    squeeze,
    squeeze_rising,
    squeeze_words,
    unsqueeze,
    unsqueeze_rising,
    unsqueeze_words,
)
from askloom.llm.frames import table
from askloom.llm.words import portions
from askloom.session import materialize

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TERMS = 10
# Bytes of text in a portion, bytes of text per slice of the vocabulary, groups in a block.
PORTION = 8 << 20
SLICE_BYTES = 16 << 20
BLOCK_GROUPS = 128
# Groups whose counts order the terms of a slice.
ORDERING = 6
WORD = byte_class((0x61, 0x7A), (0x80, 0xFF))

ASKS = "p int, langs array<string>, groups array<string>, blocks array<binary>"
# A column of counts of one group (source null: the whole language) in one slice, or its terms (n null).
COLUMNS = "lang string, slice int, source string, n bigint, terms bigint, blocks array<binary>"


def _count_terms(parts: int):
    """Texts to the terms of each slice: per language terms and documents with them, per group counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", PORTION):
            codes, words, bounds = spelled(batch.column("text"), WORD)
            n_words = max(1, len(words))
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lang, source))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            held = np.unique(doc * n_words + codes)  # once per document
            pairs, documents = np.unique(lang[held // n_words] * n_words + held % n_words, return_counts=True)
            group = lang * len(sources) + source
            counted, times = np.unique(group[doc] * n_words + codes, return_counts=True)
            names = words.to_pylist()
            part = part_of(names, parts)
            rows = []
            for p, own in dealt(part[pairs % n_words]):
                mine = pairs[own]
                blocks = [squeeze_words([names[w] for w in mine % n_words]), squeeze(mine // n_words), squeeze(documents[own])]
                rows.append([p, blocks, mine])
            by_part = dict(dealt(part[counted % n_words]))
            for row in rows:
                some = by_part[row[0]]
                g, w = counted[some] // n_words, counted[some] % n_words
                place = np.searchsorted(row[2], g // len(sources) * n_words + w)
                row[1] += [squeeze(g % len(sources)), squeeze(place), squeeze(times[some])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([langs] * len(rows), pa.list_(pa.string())),
                    pa.array([sources] * len(rows), pa.list_(pa.string())),
                    pa.array([r[1] for r in rows], pa.list_(pa.binary())),
                ],
                names=["p", "langs", "groups", "blocks"],
            )

    return run


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal counts starts, and the counts of the runs."""
    starts = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1]))) if len(counts) else np.empty(0, np.int64)
    return starts, counts[starts]


def _merge(least: int):
    """One slice: all portions' counts added, rare terms left out, each group's column in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs, documents, sources, places, times = ([] for _ in range(6))
        lang_ids: dict[str, int] = {}
        source_ids: dict[str, int] = {}
        first = 0
        slice_no = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                b = row["blocks"]
                lang_of = np.array([lang_ids.setdefault(x, len(lang_ids)) for x in row["langs"]])
                source_of = np.array([source_ids.setdefault(x, len(source_ids)) for x in row["groups"]])
                words.append(pa.array(unsqueeze_words(b[0]), pa.binary()))
                langs.append(lang_of[unsqueeze(b[1])])
                documents.append(unsqueeze(b[2]))
                sources.append(source_of[unsqueeze(b[3])])
                places.append(unsqueeze(b[4]) + first)
                times.append(unsqueeze(b[5]))
                first += len(langs[-1])
                slice_no = row["p"]
        if not words:
            return
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        names = coded.dictionary
        langs, documents, sources, places, times = map(np.concatenate, (langs, documents, sources, places, times))
        keys, entry = np.unique(langs * len(names) + coded.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, entry, documents)
        held, which = np.unique(sources * len(keys) + entry[places], return_inverse=True)
        counts = np.zeros(len(held), dtype=np.int64)
        np.add.at(counts, which, times)
        source, key = held // len(keys), held % len(keys)
        lang_names, source_names = list(lang_ids), list(source_ids)
        for code, lang in enumerate(lang_names):
            kept = np.flatnonzero((keys // len(names) == code) & (total >= least))
            if not len(kept):
                continue
            place = np.full(len(keys), -1)
            place[kept] = np.arange(len(kept))
            mine = np.flatnonzero(place[key] >= 0)
            at, own, n = place[key[mine]], source[mine], counts[mine]
            present, group = np.unique(own, return_inverse=True)
            sums = np.bincount(group, n, len(present)).astype(np.int64)
            columns = {g: (at[group == g], n[group == g]) for g in range(len(present))}
            whole = np.zeros(len(kept), dtype=np.int64)
            np.add.at(whole, at, n)

            def dense(g: int) -> np.ndarray:
                out = np.zeros(len(kept), dtype=np.int64)
                out[columns[g][0]] = columns[g][1]
                return out

            leading = [dense(g) for g in np.argsort(-sums, kind="stable")[:ORDERING]]
            order = np.lexsort([whole, *reversed(leading)])
            terms = names.take(pa.array(keys[kept][order] % len(names))).to_pylist()
            rows = [(lang, slice_no, None, None, len(kept), [squeeze_words(terms)])]
            for g, s in [(None, None), *enumerate(present.tolist())]:
                column = (whole if g is None else dense(g))[order]
                starts, values = runs(column)
                rows.append((lang, slice_no, None if g is None else source_names[s], int(column.sum()), len(kept), [squeeze_rising(starts), squeeze(values)]))
            # the language's own column has no source, which no group has: null sources were read as ''
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())))],
                names=["lang", "slice", "source", "n", "terms", "blocks"],
            )

    return run


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Exact shares of runs of counts; each distinct count is divided once, as Python numbers have no bound."""
    distinct, place = np.unique(counts, return_inverse=True)
    out = [1 + SCALE * (c + 2) // (total + 2 * terms) for c in distinct.tolist()]
    return np.array(out, dtype=np.int64)[place]


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def stretched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of the differences of two columns of runs over ``size`` terms: once per stretch, times its length."""
    starts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    return int((difference(p, q) * np.diff(np.append(starts, size))).sum())


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Columns of two blocks of groups in one slice: their pairs; of a block with itself also its highest terms."""
    first, second = key[2].as_py(), key[3].as_py()
    size, terms, whole = 0, None, None
    blocks: dict[int, list] = {first: [], second: []}
    for row in rows.to_pylist():
        size = row["terms"]
        if row["total"] is None:
            terms = unsqueeze_words(row["blocks"][0])
            continue
        if row["blocks"] is None:  # a group without any of these terms
            starts, counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        else:
            starts, counts = unsqueeze_rising(row["blocks"][0]), unsqueeze(row["blocks"][1])
        column = (starts, shares(counts, row["total"], row["vocabulary"]))
        if row["source"] is None:
            whole = column
        else:
            blocks[row["block"]].append((row["source"], column, counts))
    out = []
    lang = key[0].as_py()
    for i, (s, a, counts) in enumerate(blocks[first]):
        for t, b, _ in blocks[second][i + 1 :] if first == second else blocks[second]:
            value = stretched(a, b, size)
            out += [(lang, s, "pair", t, value), (lang, t, "pair", s, value)]
        if first != second:
            continue
        # stretches in which this group and the language have constant counts
        starts = np.union1d(a[0], whole[0])
        at = np.searchsorted(a[0], starts, "right") - 1
        p, q, n = a[1][at], whole[1][np.searchsorted(whole[0], starts, "right") - 1], counts[at]
        ends = np.append(starts[1:], size)
        high = np.flatnonzero((n > 0) & (p > q))
        value = difference(p[high], q[high])
        order = np.argsort(-value, kind="stable")
        lengths = np.cumsum((ends - starts)[high][order])
        # all terms of the stretches down to the value of the tenth term
        enough = int(np.searchsorted(lengths, TERMS)) if len(order) else 0
        lowest = value[order[min(enough, len(order) - 1)]] if len(order) else 0
        best = [(-int(v), terms[i]) for k, v in zip(high, value) if v >= lowest for i in range(starts[k], ends[k])]
        out += [(lang, s, "term", word.decode(), -v) for v, word in sorted(best)[:TERMS]]
    columns = list(zip(*out)) or [()] * 5
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs`` (``text``, ``lang``, ``source``).

    Part ``pair``: every other source of the language and the sum of the differences over its vocabulary (0 if
    that is empty). Part ``term``: the terms that the group uses more than its language does, by
    their difference, to rank ``TERMS``. Ranks run from 1 by falling value, ties by rising item (bytes).
    Null text, language and source are read as empty; repeated rows count each; texts of any length are
    counted whole; an empty table gives no rows; other columns may have any name.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # by the size of the texts alone: each pair of groups gives a row per slice
    slices = max(1, -(-size // SLICE_BYTES))
    asked = read.mapInArrow(_count_terms(slices), ASKS)
    columns = materialize(asked.repartitionById(slices, F.col("p")).mapInArrow(_merge(least_documents), COLUMNS), "columns")

    heads = columns.where("n IS NULL")  # one row per language and slice
    vocabulary = heads.groupBy("lang").agg(F.sum("terms").alias("vocabulary"))
    totals = columns.where("n IS NOT NULL AND source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.groupBy("lang", "source").agg(F.count("*").alias("_n")).drop("_n")
    groups = materialize(groups, "groups")
    in_blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_GROUPS).cast("int").alias("in_blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").join(in_blocks, "lang")
    groups = groups.fillna(0, ["total", "vocabulary"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("in_blocks")).cast("int"))
    groups = materialize(groups, "groups")
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("vocabulary").alias("vocabulary"), F.max("in_blocks").alias("in_blocks"))

    # every group has a column in every slice of its language, if need be one of zeros
    known = columns.where("n IS NOT NULL AND source IS NOT NULL").select("lang", "slice", "source", "blocks")
    full = heads.select("lang", "slice", "terms").join(groups, "lang").join(known, ["lang", "slice", "source"], "left")
    order = ["lang", "slice", "source", "block", "terms", "blocks", "total", "vocabulary", "first", "second"]
    other = F.explode(F.sequence(F.lit(0), F.col("in_blocks") - 1))
    placed = full.withColumn("_other", other).withColumn("first", F.least("block", "_other")).withColumn("second", F.greatest("block", "_other"))
    # the language's own column and its terms go to each block met with itself
    shared = columns.where("source IS NULL").join(per_lang, "lang").withColumn("total", F.when(F.col("n").isNotNull(), F.col("total")))
    shared = shared.withColumn("first", other).withColumn("second", F.col("first")).withColumn("block", F.lit(None).cast("int"))
    cells = placed.select(*order).unionByName(shared.select(*order))
    found = materialize(
        cells.groupBy("lang", "slice", "first", "second").applyInArrow(_compare, "lang string, source string, part string, item string, value bigint"),
        "found",
    )
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # languages without any term: all pairs differ by nothing
    bare = groups.where("vocabulary = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    bare = bare.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    every = pairs.unionByName(bare).unionByName(found.where("part = 'term'").select(*pairs.columns))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = every.withColumn("rank", place)
    return ranked.where(f"part = 'pair' OR rank <= {TERMS}").select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
