"""Rows of a block that are near many sparse questions at once.

Terms are dealt to groups, and a vector is folded to the length of its weights in each group. In each group the product
of the lengths is never below that of the weights (Cauchy-Schwarz), so a pair whose folded vectors multiply to less than
the wanted product is out. Folded vectors are short and dense: one matrix product in single precision tells of many pairs.
The pairs that remain are multiplied out in double precision. No pair is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from askloom.functions.vectors import DECIMALS
from askloom.operators.postings import SLACK, Block, Questions

GROUPS = 320
# Covers the rounding of folded products, as a share of the lengths.
ROUNDING = 4e-5
# Rows and questions of one matrix product, which stays in a processor's cache.
TILE_ROWS = 1024
TILE_QUESTIONS = 512
# Numbers of the rows of a tile, spread out to all terms.
TILE_NUMBERS = 1 << 20
# Questions folded at a time; for so many the rows of a tile are folded once.
FOLDED = 4096
# A question that is left with more than this share of a tile's rows reads lists instead.
MANY = 8
# Entries multiplied out in one go, and pairs that are given out together.
ENTRIES = 250_000
PAIRS = 100_000


class Folding:
    """The group of each term: heavy and light ones are dealt alike to all groups."""

    def __init__(self, block: Block, dim: int):
        self.dim, self.groups = dim, min(dim, GROUPS)
        heavy = np.argsort(-np.bincount(block.terms, block.weights**2, dim), kind="stable")
        place = np.empty(dim, np.int64)
        place[heavy] = np.arange(dim)
        turn, at = np.divmod(place, self.groups)
        self.group = np.where(turn % 2, self.groups - 1 - at, at)

    def folded(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, scale: float | np.ndarray) -> np.ndarray:
        """The folded vectors whose entries end at ``offsets``, divided by ``scale``, be it one for all or a column."""
        n = len(offsets) - 1
        place = np.repeat(np.arange(n) * self.groups, np.diff(offsets)) + self.group[terms]
        lengths = np.bincount(place, weights**2, n * self.groups).reshape(n, self.groups)
        np.sqrt(lengths, out=lengths)
        lengths /= scale
        return lengths.astype(np.float32)


def _multiplied(rows: np.ndarray, at: np.ndarray, offsets: np.ndarray, q: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of ``rows[at]``, spread out to all terms, with the questions ``q``, none of them empty."""
    sizes = offsets[q + 1] - offsets[q]
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // ENTRIES)) + 1).tolist(), len(q)]
    flat, dim, out = rows.ravel(), rows.shape[1], []
    for a, b in zip(cuts, cuts[1:]):
        size = sizes[a:b]
        before = np.cumsum(size) - size
        entry = np.arange(size.sum()) + np.repeat(offsets[q[a:b]] - before, size)
        values = flat[np.repeat(at[a:b] * dim, size) + terms[entry]]
        values *= weights[entry]
        out.append(np.add.reduceat(values, before))
    return np.concatenate(out)


def near_many(block: Block, folding: Folding, questions: Questions, bounds: np.ndarray, k: int | None) -> Iterator[tuple]:
    """``question, row, distance`` of the rows up to each question's bound, in parts; with ``k`` its nearest are among them.

    A question reads lists if its bound excludes nothing, or from the first tile on where folding leaves it many rows.
    """
    n, dim = len(block.ids), folding.dim
    tile = max(1, min(TILE_ROWS, TILE_NUMBERS // dim))
    spread = np.zeros((tile, dim))
    scale = block.longest or 1.0
    parts = [slice(a, min(a + tile, n)) for a in range(0, n, tile)]
    for first in range(0, len(questions), FOLDED):
        lengths, offsets, terms, weights = questions.part(first, first + FOLDED)
        bound = bounds[first : first + FOLDED].copy()
        wanted = 1 - bound - SLACK
        listed = np.where((wanted > 0) & (block.metric != "l2"), n, 0)  # the row from which on lists are read
        least = np.full(len(bound), np.inf, np.float32)
        told = (listed > 0) & (lengths > 0)
        least[told] = wanted[told] / (lengths[told] * scale) - ROUNDING
        if told.any():
            asked = folding.folded(offsets, terms, weights, np.where(lengths > 0, lengths, 1.0)[:, None])
        found, size = [], 0
        for part in parts if told.any() else ():
            ends, at_terms, at_weights = block.entries(part)
            folded = folding.folded(ends, at_terms, at_weights, scale)
            here = np.repeat(np.arange(len(folded)), np.diff(ends)), at_terms
            spread[here] = at_weights
            for a in range(0, len(bound), TILE_QUESTIONS):
                left = asked[a : a + TILE_QUESTIONS] @ folded.T >= least[a : a + TILE_QUESTIONS, None]
                q, at = np.divmod(np.flatnonzero(left), len(folded))
                if not len(q):
                    continue
                many = np.bincount(q, minlength=len(left)) * MANY > max(tile, MANY)
                if many.any():
                    listed[a : a + len(left)][many] = part.start
                    least[a : a + len(left)][many] = np.inf
                    kept = ~many[q]
                    q, at = q[kept], at[kept]
                    if not len(q):
                        continue
                q += a
                d = np.round(1 - _multiplied(spread, at, offsets, q, terms, weights), DECIMALS) + 0.0
                kept = np.flatnonzero(d <= bound[q])
                found.append((q[kept] + first, at[kept] + part.start, d[kept]))
                size += len(kept)
                if size >= PAIRS:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found, size = [], 0
            spread[here] = 0.0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*found))
        for q in np.flatnonzero(listed < n):
            at, d = block.near(questions[first + q], bound[q], k)
            kept = at >= listed[q]
            if kept.any():
                yield np.full(int(kept.sum()), first + q), at[kept], d[kept]
