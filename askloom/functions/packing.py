"""Greedy packing on element lengths: small Arrow helpers used by the chunking operators.

Only integers cross into Python; texts stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf

from askloom.options import ChunkOptions

SEPARATOR = "\n\n"
GAP = len(SEPARATOR)


def reach(max_characters: int) -> int:
    """Most elements one chunk can hold: every element has at least one character."""
    return (max_characters + GAP) // (1 + GAP) + 1


class _Packer:
    """Answers "where does the next chunk start" for one run of elements."""

    def __init__(self, lens: np.ndarray, breaks: np.ndarray | None, opts: ChunkOptions):
        self.n = len(lens)
        self.hard = opts.max_characters
        self.soft = opts.soft
        self.lens = lens.tolist()
        # ends[i]: text length of elements 0..i-1, each followed by a separator
        self.ends = np.concatenate(([0], np.cumsum(lens + GAP))).tolist()
        walls = lens > self.hard
        if breaks is not None:
            walls = walls | breaks
        self.walls = np.flatnonzero(walls).tolist()

    def after(self, start: int) -> int:
        """Start of the chunk that follows the chunk starting at ``start``."""
        if self.lens[start] > self.hard:
            return start + 1
        base = self.ends[start]
        # last element that still fits below the hard limit
        fits = bisect_right(self.ends, base + self.hard + GAP, start + 1) - 1
        # an element may be appended only while the chunk so far is within the soft limit
        grows = bisect_right(self.ends, base + self.soft + GAP, start + 1)
        stop = min(fits, max(grows, start + 1), self.n)
        wall = bisect_right(self.walls, start)
        if wall < len(self.walls):
            stop = min(stop, self.walls[wall])
        return max(stop, start + 1)


def _rows(lens: pa.Array, breaks: pa.Array):
    lens = lens.combine_chunks() if isinstance(lens, pa.ChunkedArray) else lens
    offsets = lens.offsets.to_numpy()
    values = lens.values.to_numpy(zero_copy_only=False)
    flags = breaks.values.to_numpy(zero_copy_only=False).astype(bool)
    flag_offsets = breaks.offsets.to_numpy()
    for i in range(len(lens)):
        row = values[offsets[i] : offsets[i + 1]].astype(np.int64)
        flag = flags[flag_offsets[i] : flag_offsets[i + 1]]
        yield row, (flag if len(flag) else None)


def chunk_starts(opts: ChunkOptions):
    """Arrow UDF ``(lens, breaks, entry, limit) -> starts`` with the end of the last chunk appended.

    Chunks begin at element ``entry``; no chunk begins at or after ``limit``.
    """

    @arrow_udf("array<int>")
    def starts(lens: pa.Array, breaks: pa.Array, entry: pa.Array, limit: pa.Array) -> pa.Array:
        out = []
        bounds = zip(_rows(lens, breaks), entry.to_pylist(), limit.to_pylist())
        for (row, flag), at, stop in bounds:
            packer = _Packer(row, flag, opts)
            found = []
            while at < min(stop, packer.n):
                found.append(at)
                at = packer.after(at)
            out.append([*found, at])
        return pa.array(out, pa.list_(pa.int32()))

    return starts


def block_exits(opts: ChunkOptions):
    """Arrow UDF ``(lens, breaks, limit) -> exits``.

    ``exits[e]`` says where, counted from the start of the next block, the first chunk of that
    block begins if the first chunk of this block begins at element ``e``.
    """
    width = reach(opts.max_characters)

    @arrow_udf("array<int>")
    def exits(lens: pa.Array, breaks: pa.Array, limit: pa.Array) -> pa.Array:
        out = []
        for (row, flag), stop in zip(_rows(lens, breaks), limit.to_pylist()):
            packer = _Packer(row, flag, opts)
            stop = min(stop, packer.n)
            leave = [0] * stop
            for i in range(stop - 1, -1, -1):
                following = packer.after(i)
                leave[i] = following - stop if following >= stop else leave[following]
            # an entry at or beyond a short last block never matters
            out.append(leave[:width] + [0] * (width - len(leave)))
        return pa.array(out, pa.list_(pa.int32()))

    return exits
