"""MinHash near-duplicates by a chosen-path set similarity join.

1. Every text becomes its set of distinct ``width``-word shingles, 64-bit hashes over whole words, and
   of that set: its size, an order-free 128-bit digest, ``POSITIONS`` minwise values, and the keys
   of its nodes on the first level of ``trees`` independent trees.
2. Documents with equal sets (equal size and digest) form a class; its smallest id goes on.
3. A node of a tree chooses ``branches`` of the minwise positions by its path and sends each of its
   documents to the children named by their values there. Two documents of similarity J stay
   together in one step with probability ``1 - (1 - J)**branches``: at 0.75 and two branches a tree keeps a
   pair with probability 0.94 on the first level and never less than 0.89 below it, so six trees
   miss a pair with probability under 2e-6. Nodes of one document end; nodes of more than ``leaf``
   documents branch again, down to ``depth``.
4. In a leaf all documents are compared by their minwise values and linked loosely (agreement far below
   what similarity 0.75 gives, five standard deviations); a large node that holds most of its parent
   or is still large at the last level, which is a family of close copies, is linked as a whole.
   The loose components are only a superset of the real ones and decide nothing.
5. The full sets of documents in a loose component meet in blocks of bounded size, each pair of blocks
   once, where every pair is compared exactly. A task emits one row per document and block
   pair, never pairs.

Nothing is capped: large nodes branch, large components are cut into more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from askloom.llm.components import components
from askloom.llm.frames import binary_rows, packed, runs, smallest_reachable, table, whole_groups
from askloom.llm.words import U, Words, mix, portions, powers, sets_of
from askloom.session import materialize

WIDTH = 5
SIMILAR = 75  # per cent
TREES = 6
BRANCHES = 2
DEPTH = 4
LEAF = 256
# A large node that holds at least this share of its parent is a family of close copies.
FAMILY = 0.75
POSITIONS = 64
# Positions that two sets of similarity 0.75 agree on: 48 on average, 3.5 standard deviation.
LEAST_AGREED = 30
# Shingles and documents per block of the exact comparison.
BLOCK_SHINGLES = 1 << 19
BLOCK_ROWS = 1024

ODD = powers(0x9E3779B97F4A7C15, POSITIONS + 1)[1:]
SKETCH = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary, nodes array<bigint>"


def chosen(path: np.ndarray, branch: int) -> np.ndarray:
    """Position that the node ``path`` looks at for one of its branches."""
    own = mix(path)
    first = own % U(POSITIONS)
    step = U(1) + (own >> U(32)) % U(POSITIONS - 1)
    return ((first + U(branch) * step) % U(POSITIONS)).astype(np.int64)


def child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(path + position.astype(U) * ODD[0]) ^ value)


def sketches(docs: DataFrame, width: int = WIDTH, trees: int = TREES, branches: int = BRANCHES) -> DataFrame:
    """``SKETCH`` per row of ``docs`` (``doc_id``, ``text``); texts without words have size 0 and no nodes."""
    roots = mix(np.arange(1, trees + 1).astype(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            values, bounds = sets_of(Words(batch.column("text"), lower=True), width)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            at = bounds[full]
            n, k = batch.num_rows, POSITIONS
            low = np.zeros((n, k), dtype=U)
            digest = np.zeros((2, n), dtype=U)
            if len(at):
                for i in range(k):
                    low[full, i] = np.minimum.reduceat(values * ODD[i], at)
                digest[0, full] = np.add.reduceat(mix(values ^ ODD[1]), at)
                digest[1, full] = np.add.reduceat(mix(values ^ ODD[2]), at)
            minwise = mix(low)
            keys = np.empty((n, trees * branches), dtype=U)
            for t in range(trees):
                for b in range(branches):
                    position = int(chosen(roots[t : t + 1], b)[0])
                    keys[:, t * branches + b] = child(roots[t : t + 1], np.array([position]), minwise[:, position])
            counts = np.where(sizes > 0, trees * branches, 0)
            nodes = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()),
                pa.array(keys[full].reshape(-1).view(np.int64)),
            )
            signature = packed((minwise & U(0xFFFFFFFF)).astype(np.uint32).reshape(-1), np.arange(n + 1) * k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    signature,
                    nodes,
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "signature", "nodes"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _branch(branches: int):
    """Rows (node, doc_id, n, signature) to the rows of their children, with the size of their parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy().view(U)
            values, _ = binary_rows(batch.column("signature"), np.uint32)
            values = values.reshape(-1, POSITIONS)
            rows = np.arange(len(node))
            for b in range(branches):
                position = chosen(node, b)
                key = child(node, position, values[rows, position].astype(U))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("doc_id"), batch.column("n")],
                    names=["node", "doc_id", "parent"],
                )

    return run


def _loose_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, doc_id, n_shingles, signature) sorted by node to links (doc_id, smaller doc_id)."""
    for rows in whole_groups(batches, ["node"]):
        node = rows.column("node").to_numpy()
        doc = rows.column("doc_id").to_numpy()
        size = rows.column("n_shingles").to_numpy()
        values, _ = binary_rows(rows.column("signature"), np.uint32)
        values = values.reshape(-1, POSITIONS)
        left, right = [], []
        step = 1
        first = np.flatnonzero(node[1:] == node[:-1])
        while len(first):
            second = first + step
            small, large = np.minimum(size[first], size[second]), np.maximum(size[first], size[second])
            fit = 100 * small >= SIMILAR * large
            a, b = first[fit], second[fit]
            close = (values[a] == values[b]).sum(axis=1) >= LEAST_AGREED
            left.append(a[close])
            right.append(b[close])
            step += 1
            first = first[first + step < len(node)]
            first = first[node[first] == node[first + step]]
        if not left:
            continue
        label = smallest_reachable(len(node), np.concatenate(left), np.concatenate(right))
        linked = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[linked]), pa.array(doc[label[linked]])], names=["a", "b"])


def loose_links(reps: DataFrame, branches: int = BRANCHES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) whose components hold every similar pair that meets in a leaf of some tree."""
    level = reps.select(F.explode("nodes").alias("node"), "doc_id", F.lit(None).cast("bigint").alias("parent"))
    carried = reps.select("doc_id", "n_shingles", "signature")
    out = None
    for k in range(depth):
        count = level.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("b")).where("n > 1")
        shared = materialize(level.join(count, "node"), "nodes")
        leaves = shared.where(F.col("n") <= leaf).select("node", "doc_id").join(carried, "doc_id")
        leaves = leaves.repartition("node").sortWithinPartitions("node", "doc_id")
        links = leaves.mapInArrow(_loose_links, "a bigint, b bigint")
        large = shared.where(F.col("n") > leaf)
        family = (F.col("n") >= FAMILY * F.col("parent")) if k + 1 < depth else F.lit(True)
        family = F.coalesce(family, F.lit(False))
        star = large.where(family & (F.col("doc_id") != F.col("b"))).select(F.col("doc_id").alias("a"), "b")
        links = links.unionByName(star)
        out = links if out is None else out.unionByName(links)
        large = large.where(~family)
        if large.isEmpty():
            break
        level = large.select("node", "doc_id", "n").join(carried.select("doc_id", "signature"), "doc_id")
        # written, since the counts and the join below would each run it
        level = materialize(level.mapInArrow(_branch(branches), "node bigint, doc_id bigint, parent bigint"), "children")
    return out.distinct()


def _sets(width: int):
    """Rows of documents with their class digest and block to rows with the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            values, bounds = sets_of(Words(batch.column("text"), lower=True), width)
            at = bounds[:-1]
            full = np.flatnonzero(np.diff(bounds))
            digest = np.zeros(batch.num_rows, dtype=U)
            if len(full):
                digest[full] = np.add.reduceat(mix(values ^ ODD[1]), at[full])
            same = pa.array(digest.view(np.int64) == batch.column("d1").to_numpy(zero_copy_only=False))
            names = ["doc_id", "component", "block", "blocks"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), packed(values, bounds)], names=[*names, "shingles"]
            ).filter(same)

    return run


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each block pair, compared on full sets; a row per document and its smallest partner.

    The shingles of a pair of blocks are numbered; one document at a time is marked on them and met
    with all others by a sum over their marks.
    """
    for rows in whole_groups(batches, ["component", "i", "j"]):
        keys = [rows.column(k).to_numpy() for k in ("component", "i", "j")]
        all_docs = rows.column("doc_id").to_numpy()
        values, bounds = binary_rows(rows.column("shingles"), U)
        edges = runs(*keys)
        left, right = [], []
        for first, last in zip(edges[:-1], edges[1:]):
            if last - first < 2:
                continue
            own, at = values[bounds[first] : bounds[last]], bounds[first:last] - bounds[first]
            size = np.diff(bounds[first : last + 1])
            _, place = np.unique(own, return_inverse=True)
            mark = np.zeros(int(place.max()) + 1, dtype=np.int32)
            ends = np.concatenate((at, [len(own)]))
            a, b = [], []
            for x in range(last - first - 1):
                mine = place[ends[x] : ends[x + 1]]
                mark[mine] = 1
                rest = place[ends[x + 1] :]
                both = np.add.reduceat(mark[rest], ends[x + 1 : -1] - ends[x + 1])
                mark[mine] = 0
                near = np.flatnonzero(100 * both >= SIMILAR * (size[x] + size[x + 1 :] - both)) + x + 1
                a.append(np.full(len(near), x))
                b.append(near)
            label = smallest_reachable(last - first, np.concatenate(a), np.concatenate(b))
            linked = np.flatnonzero(label != np.arange(last - first))
            left.append(all_docs[first + linked])
            right.append(all_docs[first + label[linked]])
        if left:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"]
            )


def _blocks(members: DataFrame) -> DataFrame:
    """Cut each loose component (column ``component``) into blocks of bounded rows and shingles."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1024)).cast("int")
    cut = members.withColumn("part", part)
    weight = F.greatest(F.lit(1 / BLOCK_ROWS), F.col("n_shingles") / BLOCK_SHINGLES)
    per = cut.groupBy("component", "part").agg(F.sum(weight).alias("w"))
    before = Window.partitionBy("component").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most 1,024 rows per component, whatever its size
    base = per.select("component", "part", "w", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("component", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(base.drop("w"), ["component", "part"]).withColumn(
        "block", F.floor(F.col("base") + F.coalesce(F.sum(weight).over(inside), F.lit(0.0))).cast("int")
    )
    total = per.groupBy("component").agg((F.floor(F.sum("w") - 1e-9) + 1).cast("int").alias("blocks"))
    return placed.join(total, "component").drop("part")


def exact_links(docs: DataFrame, reps: DataFrame, loose: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between representatives, spanning every component of the exact similarity."""
    named = loose.select(F.col("node").alias("doc_id"), "component")
    heads = loose.select(F.col("component").alias("doc_id"), "component").distinct()
    members = named.unionByName(heads).join(reps.select("doc_id", "n_shingles", "d1"), "doc_id")
    members = materialize(_blocks(members), "blocks")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(members.hint("merge"), "doc_id")
    sets = texts.mapInArrow(_sets(width), "doc_id bigint, component bigint, block int, blocks int, shingles binary")
    # block b meets every block, each unordered pair in one place
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.col("block") + 1) - 1)).alias("other")
    grid = sets.select("doc_id", "component", "block", "shingles", other).select(
        "doc_id", "component", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    keys = ["component", "i", "j"]
    return (
        grid.repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(_exact_links, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if 100 x intersection >= 75 x union of their shingle sets; null, empty and
    blank texts have an empty set and link with nothing. Repeated rows count once; of rows that share an
    id but not a text, the one with the smallest (size, digest) counts. Rows without an id are left
    out. Other columns are ignored; an empty table gives no rows.
    """
    raw = sketches(docs.select("doc_id", "text").where("doc_id is not null"), width, trees)
    one = F.min(F.struct("n_shingles", "d1", "d2", "signature", "nodes")).alias("s")
    sketch = materialize(raw.groupBy("doc_id").agg(one).select("doc_id", "s.*"), "sketches")
    klass = ["n_shingles", "d1", "d2"]
    filled = sketch.where("n_shingles > 0")
    first = materialize(filled.groupBy(*klass).agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(first, (filled.doc_id == first.rep)).select(filled["*"])
    loose = components(loose_links(reps, leaf=leaf))
    real = components(exact_links(docs, reps, loose, width))
    tops = first.join(real.withColumnRenamed("node", "rep"), "rep", "left").select(
        *klass, F.coalesce("component", "rep").alias("top")
    )
    out = sketch.select("doc_id", *klass).join(tops, klass, "left")
    found = out.select("doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its near-duplicate component.

    Rows without an id are kept: they belong to no group. Repeated rows of one id stay or go together; null and
    empty texts stay, long ones are compared whole; an empty table gives no rows; further columns may have any name.
    """
    mine = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(mine, "doc_id", "left_anti").select(*docs.columns)
