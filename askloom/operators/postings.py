"""Sparse vectors of one block by term, and the rows of a block that are near one sparse question.

A question goes through its terms by falling weight. Once the terms left cannot lift a row to the wanted product any
more (their weights' length bounds what they add), rows that have too little so far are out, and the long lists of
common terms are not read: the rows that remain are looked up one by one. No row is lost by that.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from askloom.functions.vectors import DECIMALS

# Rows and entries of one block: a task holds one at a time, and its running sums stay in a processor's cache.
BLOCK_ROWS = 8_192
BLOCK_ENTRIES = 500_000
# Covers the rounding of distances and of sums.
SLACK = 1e-6
# Of this share of a block's rows on, the lists left are read after all.
MANY = 16


class Vectors:
    """Rows of ids, ascending distinct terms and weights, end to end."""

    def __init__(self, table: pa.Table):
        ids, terms, weights = (c.combine_chunks() for c in table.columns)
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.asarray(terms.offsets).astype(np.int64)
        self.offsets -= self.offsets[0]
        self.terms = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        self.weights = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.rows(), self.weights**2, len(self)))


class Question:
    """Terms of one question by falling weight, and the length of the weights from each place on."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, cosine: bool):
        order = np.argsort(-np.abs(weights), kind="stable")
        self.terms, self.weights = terms[order], weights[order]
        tail = np.sqrt(np.cumsum((self.weights**2)[::-1])[::-1])
        self.length = tail[0] if len(tail) else 0.0
        if cosine and self.length > 0:
            self.weights, tail = self.weights / self.length, tail / self.length
        self.left = np.append(tail, 0.0)


class Questions:
    """Questions end to end; each is made ready for reading lists when it is asked for."""

    def __init__(self, vectors: Vectors, metric: str):
        self.vectors, self.cosine = vectors, metric == "cosine"
        self.lengths = vectors.lengths()

    def __len__(self) -> int:
        return len(self.vectors)

    def __getitem__(self, at: int) -> Question:
        a, b = self.vectors.offsets[at : at + 2]
        return Question(self.vectors.terms[a:b], self.vectors.weights[a:b], self.cosine)

    def part(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of some questions, where their entries end, terms and weights; unit lengths for the cosine."""
        offsets, lengths = self.vectors.offsets[begin : end + 1], self.lengths[begin:end]
        here = slice(offsets[0], offsets[-1])
        terms, weights = self.vectors.terms[here].astype(np.int64), self.vectors.weights[here]
        if self.cosine:
            usable = lengths > 0
            weights = weights / np.repeat(np.where(usable, lengths, 1.0), np.diff(offsets))
            lengths = usable.astype(np.float64)
        return lengths, offsets - offsets[0], terms, weights


class Block:
    """Rows of a block by row and, once that is asked for, by term."""

    def __init__(self, vectors: Vectors, metric: str, dim: int):
        self.ids, self.offsets, self.metric = vectors.ids, vectors.offsets, metric
        lengths = vectors.lengths()
        self.lengths, self.usable = lengths, lengths > 0
        weights = vectors.weights
        if metric == "cosine":
            weights = weights / np.repeat(np.where(self.usable, lengths, 1.0), np.diff(self.offsets))
        self.terms, self.weights = vectors.terms, weights
        self.longest = 1.0 if metric == "cosine" else lengths.max(initial=0.0)
        self.dim = dim
        self.asked = np.zeros(dim)

    @cached_property
    def _order(self) -> np.ndarray:
        # two bytes are sorted by counting
        return np.argsort(self.terms.astype(np.uint16) if self.dim <= 1 << 16 else self.terms, kind="stable")

    @cached_property
    def listed(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))[self._order]

    @cached_property
    def given(self) -> np.ndarray:
        return self.weights[self._order]

    @cached_property
    def first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=self.dim))))

    def entries(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the entries of consecutive rows end, their terms and weights."""
        offsets = self.offsets[rows.start : rows.stop + 1]
        here = slice(offsets[0], offsets[-1])
        return offsets - offsets[0], self.terms[here], self.weights[here]

    def _add(self, sums: np.ndarray, q: Question, begin: int, end: int) -> None:
        for term, weight in zip(q.terms[begin:end], q.weights[begin:end]):
            here = slice(self.first[term], self.first[term + 1])
            sums[self.listed[here]] += weight * self.given[here]

    def _looked_up(self, rows: np.ndarray, q: Question) -> np.ndarray:
        """Whole products of some rows."""
        self.asked[q.terms] = q.weights
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        before = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.offsets[rows] - before, sizes)
        sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.asked[self.terms[at]] * self.weights[at], len(rows))
        self.asked[q.terms] = 0.0
        return sums

    def _products(self, q: Question, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows, ascending, among which are all with a product of ``wanted`` or more, and their products."""
        sums = np.zeros(len(self.ids))
        if wanted <= 0:
            self._add(sums, q, 0, len(q.terms))
            return np.arange(len(sums)), sums
        # what the terms left can add is half of what is wanted at most, so few rows remain
        left = q.left * self.longest
        stop = int(np.argmax(left <= wanted / 2))
        self._add(sums, q, 0, stop)
        rows = np.flatnonzero(sums >= wanted - left[stop] - SLACK)
        if stop == len(q.terms) or not len(rows):
            return rows, sums[rows]
        if len(rows) * MANY < len(sums):
            return rows, self._looked_up(rows, q)
        self._add(sums, q, stop, len(q.terms))
        rows = np.flatnonzero(sums >= wanted - SLACK)
        return rows, sums[rows]

    def near(self, q: Question, bound: float, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a distance up to ``bound`` and these; with ``k`` the nearest of them, ties to the smaller id."""
        if self.metric == "l2":
            rows, products = self._products(q, 0.0)
            d = np.maximum(self.lengths**2 + q.length**2 - 2 * products, 0.0)
        else:
            rows, products = self._products(q, 1 - bound - SLACK)
            d = 1 - products
            if self.metric == "cosine":
                told = self.usable[rows] & (q.length > 0)
                rows, d = rows[told], d[told]
        d = np.round(d, DECIMALS) + 0.0
        if k and len(d) > k:
            bound = min(bound, np.partition(d, k - 1)[k - 1])
        kept = np.flatnonzero(d <= bound)
        if k and len(kept) > k:
            kept = kept[np.lexsort((self.ids[rows[kept]], d[kept]))[:k]]
        return rows[kept], d[kept]


def blocks_of(batches, metric: str, dim: int):
    """Batches ``id, terms, weights`` gathered into blocks; what a block is made from is let go before it is given out."""
    held, rows, entries = [], 0, 0
    step = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // dim))

    def made() -> Block:
        vectors = Vectors(pa.Table.from_batches(held))
        held.clear()
        return Block(vectors, metric, dim)

    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            size = len(part.column(1).flatten())
            if held and (rows + part.num_rows > BLOCK_ROWS or entries + size > BLOCK_ENTRIES):
                yield made()
                rows, entries = 0, 0
            held.append(part)
            rows, entries = rows + part.num_rows, entries + size
    if held:
        yield made()
