"""Words of whole texts as arrays of 64-bit hashes, computed over the bytes of an Arrow column.

A word is a run of bytes other than blank and 0x09-0x0D. Texts are cut at word ends into pieces of
about ``PIECE`` bytes, so working memory does not depend on the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole 64-bit value."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U)


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a sequence, from one prefix sum."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, dtype=U)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(values):
            n = len(values) + 1024
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        out = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * self.up[: len(values)], dtype=U, out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


# Two primes just below 2**31 and a base for each; longer words are known by a digest.
PRIMES = (2147483647, 2147483629)
LETTER_BASES = (1582147319, 1203549661)
LONG = 1 << 20


class Spelling:
    """62-bit hashes of words by their letters: polynomials modulo two primes, from one prefix sum each.

    Modulo a power of two, whole families of words (Thue-Morse sequences) share a hash whatever the base.
    """

    def __init__(self):
        self.up = self.down = [np.empty(0, dtype=np.uint32)] * 2

    @staticmethod
    def _powers(base: int, prime: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint32)
        done, step = 1, base
        while done < n:  # twice as many each time
            more = min(done, n - done)
            out[done : done + more] = out[:more].astype(U) * U(step) % U(prime)
            done, step = 2 * done, step * step % prime
        return out

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up[0]) < len(data):
            n = len(data) + 1024
            self.up = [self._powers(b, p, n) for b, p in zip(LETTER_BASES, PRIMES)]
            self.down = [self._powers(pow(b, -1, p), p, n) for b, p in zip(LETTER_BASES, PRIMES)]
        letters, parts = data.astype(U) + U(1), []
        for prime, up, down in zip(PRIMES, self.up, self.down):
            # the sum may pass 2**64, the part of one word does not
            prefix = np.zeros(len(data) + 1, dtype=U)
            np.cumsum(letters * up[: len(data)], dtype=U, out=prefix[1:])
            parts.append((prefix[end] - prefix[start]) % U(prime) * down[start] % U(prime))
        out = mix(mix((parts[0] << U(31)) | parts[1]) + (end - start).astype(U))
        for i in np.flatnonzero(end - start > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), offsets


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Word hashes of many texts: ``hashes`` in order, those of text i at ``bounds[i]:bounds[i+1]``.

    ``start`` and ``end`` give the place of each word in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, spelling: Spelling | None = None):
        self.data, offsets = buffers(texts)
        spelling = spelling or Spelling()
        first, last = int(offsets[0]), int(offsets[-1])
        found, starts, ends = [], [], []
        while first < last:
            stop = min(last, first + PIECE)
            while stop < last:  # on to the next blank, a text's end counting as one
                gap = np.flatnonzero(SPACE[self.data[stop : stop + 4096]])
                edge = offsets[np.searchsorted(offsets, stop)]
                cut = min(stop + int(gap[0]) if len(gap) else stop + 4096, int(edge))
                done, stop = bool(len(gap)) or cut == edge, cut
                if done:
                    break
            stop = min(stop, last)
            piece = self.data[first:stop]
            if lower:
                piece = LOWER[piece]
            inside = ~SPACE[piece]
            edges = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, stop, "right")] - first
            fresh = inside.copy()
            fresh[1:] &= ~inside[:-1]
            at_edge = edges[edges < len(piece)]
            fresh[at_edge] = inside[at_edge]
            over = inside.copy()
            over[:-1] &= ~inside[1:]
            before = edges[edges > 0] - 1
            over[before] = inside[before]
            a, b = np.flatnonzero(fresh), np.flatnonzero(over) + 1
            found.append(spelling.hashes(piece, a, b))
            starts.append(a + first)
            ends.append(b + first)
            first = stop
        none = np.empty(0, np.int64)
        self.hashes = np.concatenate(found) if found else np.empty(0, U)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.bounds = np.searchsorted(self.start, offsets)


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def sets_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles of each text, and the bounds per text.

    A text with fewer words has its whole word sequence as its one shingle; one without has none.
    """
    factors = powers(FACTORS[0], width + 1)[1:]
    h, bounds = words.hashes, words.bounds
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, dtype=U)
    for k in range(width):
        rolled += h[k : k + n] * factors[k]
    rolled = mix(rolled)
    parts, sizes = [], np.zeros(len(bounds), dtype=np.int64)
    for i in range(len(bounds) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix(np.atleast_1d((h[a:b] * factors[: b - a]).sum(dtype=U)) + U(b - a))
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.cumsum(sizes)
