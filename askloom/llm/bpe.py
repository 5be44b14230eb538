"""Word-end BPE by backtracking, and decoding through an offset table.

The vocabulary file is that of a public tokenizer for the tokenizers library: a BPE model with word
ends over byte letters, text in NFC and lower case, white space dropped. It is read on the driver and
broadcast; its size does not depend on the data.

Encoding: an Aho-Corasick automaton over all tokens gives the longest token that starts at a place of a
word. It, or else the longest of its beginnings that is a token, is taken if it is compatible with the token
before it, that is, merging both tokens' text gives exactly these two; where none fits, the last token is given
up for a shorter one and the place is never tried again, so a word takes linear time. The result is the sequence of the exact
merges. Distinct words are encoded once per task.

Decoding: all token strings lie in one byte table; a token's offset and length there give its bytes, and a
batch of ids becomes one gather.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.frames import table
from askloom.llm.words import portions

END = "\ue000"  # stands for the word-end mark, which no byte letter can be
SUFFIX = "</w>"
CACHED_WORDS = 400_000


class _Known(dict):
    """Words and their ids; a word that is missing is encoded and kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, raw: str) -> tuple[int, ...]:
        ids = self[raw] = self.find(raw)
        return ids


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file's text."""

    def __init__(self, source: str):
        import ahocorasick
        import regex

        model = json.loads(source)
        vocab = model["model"]["vocab"]
        if model["model"].get("end_of_word_suffix") != SUFFIX:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.blank = regex.compile(r"\s+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        self.rank, self.parts = {}, {}
        for k, (a, b) in enumerate(model["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = k
            self.parts.setdefault(whole, (left, right, k))
        self.tokens = ahocorasick.Automaton()
        self.text: dict[int, str] = {}
        self.shorter_of: dict[int, int | None] = {}
        for token, number in vocab.items():
            if number in self.parts or len(token.removesuffix(SUFFIX)) == 1:
                own = token.removesuffix(SUFFIX) + END if token.endswith(SUFFIX) else token
                self.tokens.add_word(own, number)
                self.text[number] = own
        self.tokens.make_automaton()
        self.size = {number: len(own) for number, own in self.text.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Known(self.word)
        self.known_pieces: dict[str, tuple[int, ...]] = {}
        strings = {number: token for token, number in vocab.items()} | {n: s for s, n in self.special.items()}
        table_ = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in table_])))
        self.bytes = np.frombuffer(b"".join(table_), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens leaves exactly these two.

        Their merges are taken back from the last to the first. A merge across the border spoils the pair
        if its turn comes before what it would have to wait for: to the left, merges of equal rank
        happen first.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, never = left, right, len(self.rank)
        limit, fits = never, True
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < limit:
                fits = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and pa_[2] > pb[2]):
                limit, a = pa_[2], pa_[1]
            else:
                limit, b = pb[2] + 1, pb[0]
        self.fits[left, right] = fits
        return fits

    def merged(self, word: str) -> tuple[int, ...]:
        """Token ids of one piece, given in byte letters."""
        text = word + END
        n = len(text)
        tokens, size, fits = self.tokens, self.size, self.fits
        out: list[int] = []
        at = 0
        closed: set[int] = set()
        longest = tokens.iter_long(text)  # one longest match after the other, while they fit
        found = next(longest, None)
        while at < n:
            token = found[1] if found and found[0] - size[found[1]] + 1 == at else None
            fresh = token is not None
            while token is not None:
                end = at + size[token]
                if end not in closed and (
                    not out or (fits[out[-1], token] if (out[-1], token) in fits else self.compatible(out[-1], token))
                ):
                    break
                token, fresh = self.shorter(token), False
            while token is None:  # nothing fits here: give up the last token for a shorter one
                closed.add(at)
                last = out.pop()
                at -= size[last]
                token = self.shorter(last)
                while token is not None and (
                    at + size[token] in closed or (out and not self.compatible(out[-1], token))
                ):
                    token = self.shorter(token)
                fresh = False
            out.append(token)
            at += size[token]
            if not fresh:
                longest = tokens.iter_long(text, at) if at < n else iter(())
            found = next(longest, None)
        return tuple(out)

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper beginning of this one."""
        if token not in self.shorter_of:
            text = self.text[token]
            starts = (text[:k] for k in range(len(text) - 1, 0, -1))
            self.shorter_of[token] = next((self.tokens.get(s) for s in starts if self.tokens.exists(s)), None)
        return self.shorter_of[token]

    def word(self, raw: str) -> tuple[int, ...]:
        """Token ids of a stretch of text without white space."""
        letters = self.letters
        text = unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()
        parts = []
        for piece in self.pieces.findall(text):
            ids = self.known_pieces.get(piece)
            if ids is None:
                ids = self.merged("".join([letters[b] for b in piece.encode()]))
                self.known_pieces[piece] = ids
            parts.append(ids)
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
            self.known_pieces.clear()
        return parts[0] if len(parts) == 1 else tuple(chain.from_iterable(parts))

    def stretch(self, text: str) -> Iterator[tuple[int, ...]]:
        parts = self.blank.split(text) if self.odd.search(text) else text.split()
        return map(self.words.__getitem__, parts)

    def encode(self, text: str) -> Iterator[int]:
        if self.apart is None or not any(s in text for s in self.special):
            return chain.from_iterable(self.stretch(text))
        parts = self.apart.split(text)
        each = ([(self.special[s],)] if s in self.special else self.stretch(s) for s in parts)
        return chain.from_iterable(chain.from_iterable(each))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Token strings of each row joined by one blank."""
        at = self.offsets[ids]
        length = self.offsets[ids + 1] - at
        ends = np.concatenate(([0], np.cumsum(length)))
        places = np.arange(ends[-1]) - np.repeat(ends[:-1] - at, length)
        data = self.bytes[places].tobytes()
        edge = ends[bounds]
        return [data[a : b - 1].decode() if b > a else "" for a, b in zip(edge[:-1], edge[1:])]


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _arrow_list(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def _with(docs: DataFrame, added: str) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(added).fields])


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """Columns of ``docs`` and ``_ids array<int>``, the tokens of ``text``; with ``decoded`` also ``_decoded``.

    Null and empty texts have no tokens; repeated rows are encoded each; no row is dropped. The columns of ``docs``
    may have any names but those two.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(source.value)
        for batch in portions(batches, "text"):
            rows = [list(bpe.encode(t or "")) for t in batch.column("text").to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            ids = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(bounds[-1]))
            out = [*batch.columns, _arrow_list(ids, bounds)]
            if decoded:
                out.append(pa.array(bpe.decode(ids, bounds), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "_ids", "_decoded"][: len(out)])

    added = "_ids array<int>, _decoded string" if decoded else "_ids array<int>"
    return docs.mapInArrow(run, _with(docs, added))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Columns of ``tokens`` and ``_decoded``, the token strings of ``_ids`` joined by one blank (null: empty)."""
    source = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(source.value)
        for batch in batches:
            lists = batch.column("_ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            texts = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "_decoded"])

    return tokens.mapInArrow(run, _with(tokens, "_decoded string"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return both.select(
        "doc_id",
        F.size("_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )
