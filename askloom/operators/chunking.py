"""Elements to size-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions.packing import SEPARATOR, block_exits, chunk_starts, reach
from askloom.functions.text import split_oversized
from askloom.options import ChunkOptions
from askloom.schemas import CHUNK_COLUMNS, TITLE
from askloom.session import materialize

# Elements of one source packed in one row; longer sources are cut into blocks of this size.
BLOCK = 4096
# Rows of one block each that may be broadcast.
BROADCAST_BLOCKS = 100_000
# Blocks whose exits are combined in one group.
SUPER = 512


def _lens(elements: Column) -> Column:
    return F.transform(elements, lambda e: F.length(e["text"]))


def _breaks(elements: Column, opts: ChunkOptions) -> Column:
    if opts.by_title:
        return F.transform(elements, lambda e: e["category"] == TITLE)
    return F.array().cast("array<boolean>")


def _texts(elements: Column, starts: Column, opts: ChunkOptions) -> Column:
    """Chunk texts from element starts; an oversized element gives several."""
    firsts = F.slice(starts, F.lit(1), F.size(starts) - 1)
    groups = F.transform(
        firsts, lambda s, i: F.slice(elements, s + 1, F.element_at(starts, i + 2) - s)
    )
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.when(
                F.length(g[0]["text"]) > opts.max_characters,
                split_oversized(g[0]["text"], opts.max_characters, opts.overlap),
            ).otherwise(F.array(F.array_join(g["text"], SEPARATOR))),
        )
    )


def _packed(df: DataFrame, entry: Column, limit: Column, opts: ChunkOptions) -> DataFrame:
    elements = F.col("elements")
    starts = chunk_starts(opts)(_lens(elements), _breaks(elements, opts), entry, limit)
    return df.withColumn("_starts", starts).withColumn(
        "_chunks", _texts(elements, F.col("_starts"), opts)
    )


def chunk_documents(docs: DataFrame, opts: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of sources that hold their elements in one row.

    ``docs``: source_id, source_ord, elements ``array<struct<category,text>>``. Nothing is
    shuffled: packing works on the array, and only element lengths visit Python.
    """
    packed = _packed(docs, F.lit(0), F.size("elements"), opts)
    # outer: a plain generator would add a "not empty" filter that repeats the whole computation
    exploded = packed.select(
        "source_id", "source_ord", F.posexplode_outer("_chunks").alias("chunk_ord", "text")
    ).where(F.col("text").isNotNull())
    return exploded.select(
        "source_id",
        "source_ord",
        F.col("chunk_ord").cast("bigint").alias("chunk_ord"),
        "text",
        F.length("text").alias("n_chars"),
    ).select(*CHUNK_COLUMNS)


def _blocks(elements: DataFrame, opts: ChunkOptions, block: int, *columns: str) -> DataFrame:
    """One row per block of each source: its elements plus the reach of one chunk beyond it."""
    halo = reach(opts.max_characters)
    own = F.floor(F.col("elem_ord") / block)
    homes = F.when(
        (F.col("elem_ord") % block < halo) & (own > 0), F.array(own - 1, own)
    ).otherwise(F.array(own))
    return (
        elements.withColumn("_block", F.explode(homes))
        .groupBy("source_id", "source_ord", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("elem_ord", *columns))).alias("elements"))
    )


def _block_entries(elements: DataFrame, opts: ChunkOptions, block: int) -> DataFrame:
    """First chunk start within each block of the sources that have more than one.

    Where a block is entered decides where it is left, so each block becomes a small table
    entry -> exit. Tables of ``SUPER`` blocks are combined into one, and so on level by level until one
    group per source is left; entries then go down the same tree. No task sees more than one group.
    """
    slim = elements.withColumn("n", F.length("text"))
    many = _blocks(slim, opts, block, "category", "n").where(
        (F.col("_block") > 0) | (F.size("elements") > block)
    )
    lens = F.transform("elements", lambda e: e["n"])
    exits = block_exits(opts)(lens, _breaks(F.col("elements"), opts), F.lit(block))
    source = ["source_id", "source_ord"]
    # written once: every level reads it or what is made of it, and its last block tells how many levels there are
    tables = materialize(many.select(*source, F.col("_block").cast("bigint").alias("_block"), exits.alias("exits")), "exits")
    width = reach(opts.max_characters)
    identity = F.sequence(F.lit(0), F.lit(width - 1))

    def grouped(level: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("_block", "exits")))
        up = F.floor(F.col("_block") / SUPER).alias("_up")
        return level.groupBy(*source, up).agg(F.transform(rows, lambda s: s["exits"]).alias("all_exits"))

    def combined(groups: DataFrame) -> DataFrame:
        follow = F.aggregate("all_exits", identity, lambda acc, x: F.transform(acc, lambda e: F.element_at(x, e + 1)))
        return groups.select(*source, F.col("_up").alias("_block"), follow.alias("exits"))

    def spread(groups: DataFrame) -> DataFrame:
        """Entries of the members of groups: follow the exits from the group's own entry."""
        path = F.aggregate(
            F.col("all_exits"),
            F.array(F.col("entry")),
            lambda p, x: F.array_append(p, F.element_at(x, F.element_at(p, -1) + 1)),
        )
        inner = F.slice(path, F.lit(1), F.size("all_exits"))
        members = groups.select(*source, "_up", F.posexplode_outer(inner).alias("_i", "entry"))
        return members.select(*source, (F.col("_up") * SUPER + F.col("_i")).alias("_block"), "entry")

    levels = [grouped(tables)]
    last = (tables.agg(F.max("_block")).first()[0] or 0) // SUPER
    while last:
        levels.append(grouped(combined(levels[-1])))
        last //= SUPER
    entries = spread(levels[-1].withColumn("entry", F.lit(0)))
    for lower in reversed(levels[:-1]):
        entries = spread(lower.join(entries.withColumnRenamed("_block", "_up"), [*source, "_up"]))
    return entries


def _beside_texts(places: DataFrame, label: str) -> DataFrame:
    """A small row per block, written, to be joined with texts: broadcast if it is counted few, so that no text moves."""
    stored = materialize(places, label)
    return F.broadcast(stored) if stored.count() <= BROADCAST_BLOCKS else stored


def chunk_elements(
    elements: DataFrame, opts: ChunkOptions = ChunkOptions(), block: int = BLOCK
) -> DataFrame:
    """Chunks of sources that hold one element per row; ``elem_ord`` counts 0..n-1 per source.

    A source may hold any share of all rows: it is cut into blocks, where each block's first chunk
    begins is worked out from lengths alone, and the blocks are then packed independently.
    """
    if block < reach(opts.max_characters):
        raise ValueError("a block must hold at least one full chunk")
    entries = _beside_texts(_block_entries(elements, opts, block), "entries")
    place = ["source_id", "source_ord", "_block"]
    # joins on the grouping keys: the texts stay where their one shuffle put them
    blocks = _blocks(elements, opts, block, "category", "text").join(entries, place, "left")
    packed = _packed(
        blocks.withColumn("entry", F.coalesce("entry", F.lit(0))),
        F.col("entry"),
        F.least(F.lit(block), F.size("elements")),
        opts,
    )
    # only sources of several blocks need a chunk number to start from
    several = (F.col("_block") > 0) | (F.size("elements") > block)
    # written once: numbers of chunks are asked for before the texts
    packed = materialize(packed.select(*place, several.alias("_several"), F.size("_chunks").alias("n"), "_chunks"), "packed")
    sizes = packed.where("_several").select(*place, "n")
    earlier = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*place, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    pieces = packed.join(_beside_texts(bases, "bases"), place, "left").select(
        "source_id",
        "source_ord",
        F.coalesce("_base", F.lit(0)).alias("_base"),
        F.posexplode_outer("_chunks").alias("_i", "text"),
    )
    return pieces.where(F.col("text").isNotNull()).select(
        "source_id",
        "source_ord",
        (F.col("_base") + F.col("_i")).cast("bigint").alias("chunk_ord"),
        "text",
        F.length("text").alias("n_chars"),
    )
