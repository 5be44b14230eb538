"""Words of whole texts as exact dictionary codes, and number arrays packed small for a shuffle.

Operators that look up far more items than a row per item could carry send them as blocks: one row per
portion of the corpus and part of a table, whose binary columns hold whole arrays.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from askloom.llm.words import LOWER, buffers

HEAD = 9


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the 256 bytes; those in the given inclusive ranges are set."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


def spelled(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts, A-Z lower-cased: a code per word, the distinct words, the bounds per text.

    A word is a run of bytes of the class ``inside`` within one text. Words are compared by their
    bytes, never by a hash. Null texts have none.
    """
    data, offsets = buffers(texts)
    data = LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    member = inside[data]
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = member[edges]
    last[edges - 1] = member[edges - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    ends = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(data[member])])
    coded = words.dictionary_encode()
    bounds = np.searchsorted(starts, offsets)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, bounds


def squeeze(values: np.ndarray) -> bytes:
    """Integers (not negative) as compressed byte planes."""
    values = np.ascontiguousarray(values, dtype=np.int64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unsqueeze(block: bytes) -> np.ndarray:
    n, width = int.from_bytes(block[:8], "little"), block[8]
    out = np.zeros((n, 8), dtype=np.uint8)
    if n and width:
        planes = pa.decompress(block[HEAD:], n * width, "zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return out.view(np.int64).reshape(-1)


def squeeze_rising(values: np.ndarray) -> bytes:
    """Integers that never fall, by their differences."""
    return squeeze(np.diff(values, prepend=0))


def unsqueeze_rising(block: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(block))


def squeeze_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def unsqueeze_bytes(block: bytes) -> bytes:
    n = int.from_bytes(block[:8], "little")
    return pa.decompress(block[8:], n, "zstd", asbytes=True) if n else b""


def squeeze_doubles(values: np.ndarray) -> bytes:
    return squeeze_bytes(np.ascontiguousarray(values, dtype=np.float64).tobytes())


def unsqueeze_doubles(block: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze_bytes(block), dtype=np.float64)


def squeeze_words(words: list[bytes]) -> bytes:
    """One word or more without line breaks."""
    return squeeze_bytes(b"\n".join(words))


def unsqueeze_words(block: bytes) -> list[bytes]:
    return unsqueeze_bytes(block).split(b"\n")


def part_of(words: list[bytes], parts: int) -> np.ndarray:
    """Part of a table that each word belongs to."""
    return np.fromiter((zlib.crc32(w) for w in words), dtype=np.int64, count=len(words)) % parts


def dealt(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each part that occurs, the places of its items, rising."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]))) if len(found) else []
