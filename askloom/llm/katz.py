"""Katz backoff language model: probabilities of whole texts, learned from part of them.

Tokens are the words of a text, A-Z lower-cased, and one end after the last. An n-gram seen c times in
training after a context seen C times has the probability ``d[c] * c / C``, with Good-Turing discounts
``d`` for counts up to ``HIGHEST``. What a context keeps back goes to the words it was never followed by,
in proportion to their probability after the shorter context; the backoff weight
``alpha = kept back / (1 - sum of the shorter-context probabilities of the words seen)`` makes each
distribution sum to one exactly. One slot stands for all unknown words and gets what the single words
keep back. A context without any count up to ``HIGHEST`` would keep nothing back: its total counts one more.

Where Good-Turing's formula gives no discount strictly between 0 and 1 for all counts up to k, a smaller
k is taken, and if none will do, ``d[r] = 1 - 0.5 / r``.

How it runs
-----------
The corpus is cut into portions of some megabytes, kept as arrays of local word codes. Tables are cut into
parts by a hash. For each order a portion asks every part, in one row, for its distinct n-grams together
with how often training documents hold them; the part adds these up, which gives the table, keeps the
table, and answers each portion in one row. So a frequent n-gram costs one entry per portion, and no
row is made per token. A context with a large share of all tokens is split over parts by its next word;
there are at most two such contexts per part, whose totals are broadcast. When all orders are answered,
each portion scores its tokens: recursively, an unseen n-gram falling back on the next lower order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.blocks import (
    byte_class,
    dealt,
    part_of,
    spelled,
    squeeze,
    squeeze_doubles,
    squeeze_rising,
    squeeze_words,
    unsqueeze,
    unsqueeze_doubles,
    unsqueeze_rising,
    unsqueeze_words,
)
from askloom.llm.frames import table
from askloom.llm.words import U, mix, portions
from askloom.session import materialize, new_table_path

ORDER = 2
# Highest count that is discounted.
HIGHEST = 5
# Bytes of text in a portion, tokens per part of a table.
PORTION = 8 << 20
PART_TOKENS = 4_000_000
WORD = byte_class((0, 8), (14, 31), (33, 255))
# Neither can be a word.
END, START = b"", b" "

PORTIONS = "j bigint, ids array<bigint>, trained array<boolean>, n_words bigint, sizes binary, tokens binary, words binary, n_tokens bigint"
ASKS = "p int, j bigint, blocks array<binary>"
# kind: answer (to portion j), grams (the table), hot (contexts that are split over parts).
TOLD = "p int, j bigint, blocks array<binary>, numbers array<bigint>, kind string"


@dataclass(frozen=True)
class Level:
    """What is known of one order when its table is complete: discounts by count, totals of split contexts."""

    discount: np.ndarray
    used: int  # highest count that is discounted
    # for order 1: training tokens, what their shares are taken of, distinct ones, probability of an unknown one
    total: int = 0
    out_of: int = 1
    distinct: int = 0
    kept: float = 0.0
    hot: dict = field(default_factory=dict)  # code -> (least count, counts of counts, sum of lower probabilities)


def discounts(n: list[int]) -> tuple[np.ndarray, int]:
    """Discount of each count from 0 to ``HIGHEST + 1`` (for all above), and the highest discounted count.

    ``n[r]``: number of n-grams seen r times, for r up to ``HIGHEST + 1``.
    """
    out = np.ones(HIGHEST + 2)
    for k in range(HIGHEST, 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            out[1 : k + 1] = d
            return out, k
    out[1 : HIGHEST + 1] = 1 - 0.5 / np.arange(1, HIGHEST + 1)
    return out, HIGHEST


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to portions."""
    names = ["j", "ids", "trained", "n_words", "sizes", "tokens", "words", "n_tokens"]
    j = TaskContext.get().partitionId() << 33
    for batch in portions(batches, "text", PORTION):
        codes, words, bounds = spelled(batch.column("text"), WORD)
        per = np.diff(bounds)
        tokens = np.full(len(codes) + len(per), len(words), dtype=np.int64)  # an end, unless
        tokens[np.arange(len(codes)) + np.repeat(np.arange(len(per)), per)] = codes
        row = [
            [j], [batch.column("doc_id").to_pylist()], [batch.column("trained").to_pylist()], [len(words)],
            [squeeze(per + 1)], [squeeze(tokens)], [squeeze_words([*words.to_pylist(), END, START])], [len(tokens)],
        ]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), *[pa.binary()] * 3, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=names)
        j += 1


def _ask_rows(rows: list[tuple]) -> pa.Table:
    p, j, blocks = zip(*rows) if rows else ((), (), ())
    columns = [pa.array(p, pa.int32()), pa.array(j, pa.int64()), pa.array(blocks, pa.list_(pa.binary()))]
    return pa.Table.from_arrays(columns, names=["p", "j", "blocks"])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.string()]
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["p", "j", "blocks", "numbers", "kind"])


def _ask_words(parts: int):
    """Portions to the words they ask for: places in the portion, words, counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unsqueeze_words(row["words"])
                sizes, trained = unsqueeze(row["sizes"]), np.array(row["trained"], dtype=bool)
                times = np.bincount(unsqueeze(row["tokens"])[np.repeat(trained, sizes)], minlength=len(words))
                times[-1] = trained.sum()
                rows = [
                    (p, row["j"], [squeeze_rising(at), squeeze_words([words[i] for i in at]), squeeze(times[at])])
                    for p, at in dealt(part_of(words, parts))
                ]
                yield from _ask_rows(rows).to_batches()

    return run


def _all_rows(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, list[bytes]]]:
    return [(r["p"], r["j"], r["blocks"]) for b in batches for r in b.to_pylist()]


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _counts_of(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, HIGHEST + 2), minlength=HIGHEST + 3)[: HIGHEST + 2].tolist()


def _add_words(parts: int):
    """One part of the table of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _all_rows(batches)
        if not asked:
            return
        p = asked[0][0]
        lists = [unsqueeze_words(b[1]) for _, _, b in asked]
        coded = pa.array([w for each in lists for w in each], pa.binary()).dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        times = np.concatenate([unsqueeze(b[2]) for _, _, b in asked])
        counts = np.zeros(len(words), dtype=np.int64)
        np.add.at(counts, place, times)
        rows = []
        for (_, j, b), own in zip(asked, _cut(place, [len(x) for x in lists])):
            rows.append((p, j, [b[0], squeeze(counts[own]), squeeze(own * parts + p)], None, "answer"))
        real = counts[[w != START for w in words]]
        numbers = [*_counts_of(real), int(real.sum()), int((real > 0).sum())]
        rows.append((p, None, [squeeze_words(words), squeeze(counts)], numbers, "grams"))
        yield _told(rows)

    return run


class Portion:
    """One portion with the answers so far. Per order: the grams of its tokens, their counts and probabilities."""

    def __init__(self, row: dict, answers: list[dict], levels: list[Level]):
        self.j, self.levels, n = row["j"], levels, row["n_words"] + 2
        self.sizes = unsqueeze(row["sizes"])
        self.trained = np.array(row["trained"], dtype=bool)
        self.tokens = unsqueeze(row["tokens"])
        self.width = n
        starts = np.cumsum(self.sizes) - self.sizes
        self.learns = np.repeat(self.trained, self.sizes)
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.sizes)
        self.answers = answers
        counts, codes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for a in answers:
            if a["level"] == 1:
                at = unsqueeze_rising(a["blocks"][0])
                counts[at], codes[at] = unsqueeze(a["blocks"][1]), unsqueeze(a["blocks"][2])
        one = levels[0]
        seen = one.discount[np.minimum(counts, HIGHEST + 1)] * counts / one.out_of
        self.word_codes, self.word_counts = codes, counts
        # of the highest order reached: gram of each token, count, code and probability of each gram
        self.gram, self.counts, self.codes = self.tokens, counts, codes
        self.prob = np.where(counts > 0, seen, one.kept)
        self.order = 1
        while self.order < len(levels):
            self.step()
            self.judge(levels[self.order - 1])

    def step(self) -> None:
        """The grams of the next order: pairs of a context of the present order and a word.

        The first token of a text has the start as its only context, so the longer orders leave it alone.
        """
        self.order += 1
        m = self.order
        if m == 2:
            before = np.concatenate(([0], self.tokens[:-1]))
            before[self.place == 0] = self.width - 1
        else:
            before = np.concatenate(([0], self.gram[:-1]))
        self.valid = np.flatnonzero(self.place >= m - 2)
        keys = before[self.valid] * self.width + self.tokens[self.valid]
        self.keys, first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.context, self.word = self.keys // self.width, self.keys % self.width
        self.lower = self.gram[self.valid[first]]
        self.context_counts, self.context_codes = self.counts[self.context], self.codes[self.context]
        self.lower_prob, self.lower_gram = self.prob, self.gram
        self.possible = (self.context_counts > 0) & (self.counts[self.lower] > 0)
        # contexts whose backoff weight may be needed: a trained token was seen, so it never falls back
        needed = np.zeros(len(self.counts), dtype=bool)
        needed[self.context[self.inverse[~self.learns[self.valid]]]] = True
        self.needed = np.flatnonzero(needed & (self.counts > 0))

    def judge(self, level: Level) -> None:
        """Counts and probabilities of the grams of the present order, from the answers."""
        n = len(self.keys)
        counts, codes, least = (np.zeros(n, dtype=np.int64) for _ in range(3))
        kept, lower_sum = np.zeros((len(self.counts), HIGHEST + 1)), np.zeros(len(self.counts))
        for a in self.answers:
            if a["level"] == self.order:
                b = a["blocks"]
                at = unsqueeze_rising(b[0])
                counts[at], codes[at], least[at] = unsqueeze(b[1]), unsqueeze(b[2]) if b[2] else 0, unsqueeze(b[3])
                at = unsqueeze_rising(b[4])
                kept[at] = unsqueeze(b[5]).reshape(-1, HIGHEST + 1)
                lower_sum[at] = unsqueeze_doubles(b[6])
        least_of = np.zeros(len(self.counts), dtype=np.int64)
        least_of[self.context[self.possible]] = least[self.possible]
        if level.hot:
            for c in np.unique(self.context):
                known = level.hot.get(int(self.codes[c]))
                if known and self.counts[c] > 0:
                    least_of[c], kept[c], lower_sum[c] = known
        # a context all of whose counts are high, or that keeps nothing back, counts one more
        few = np.where(kept[:, 0] > 0, kept[:, 1 : level.used + 1].any(axis=1), least_of <= level.used)
        total = self.counts + ~few
        back = np.where(few, kept @ (np.arange(HIGHEST + 1) * (1 - level.discount[: HIGHEST + 1])), 1.0)
        alpha = back / np.maximum(total, 1) / np.maximum(1 - lower_sum, 1e-300)
        below = self.lower_prob[self.lower]
        backed = np.where(self.context_counts > 0, alpha[self.context] * below, below)
        seen = level.discount[np.minimum(counts, HIGHEST + 1)] * counts / np.maximum(total[self.context], 1)
        gram = np.full(len(self.tokens), -1)
        gram[self.valid] = self.inverse
        # tokens that have no context of this length keep their shorter gram, moved behind the others
        short = np.flatnonzero(self.place < self.order - 2)
        gram[short] = n + np.arange(len(short))
        old = self.lower_gram[short]
        self.counts = np.concatenate((counts, np.zeros(len(short), dtype=np.int64)))
        self.codes = np.concatenate((codes, np.zeros(len(short), dtype=np.int64)))
        self.prob = np.concatenate((np.where(counts > 0, seen, backed), self.lower_prob[old]))
        self.gram = gram

    def asks(self, parts: int, share: int) -> list[tuple]:
        """Per part: places of the grams, contexts, words, counts in training, lower probabilities, and the
        contexts whose backoff weight is needed; last, the split contexts among them."""
        times = np.bincount(self.inverse[self.learns[self.valid]], minlength=len(self.keys))
        pieces = 1 + self.counts // share
        at = np.flatnonzero(self.possible)
        context, word = self.context_codes[at], self.word_codes[self.word[at]]
        piece = (mix(word.astype(U)) % pieces[self.context[at]].astype(U)).astype(np.int64)
        needed = self.needed[pieces[self.needed] == 1]
        part = self._part(context, piece, parts)
        needed_part = self._part(self.codes[needed], np.zeros(len(needed), dtype=np.int64), parts)
        grams, wanted = dict(dealt(part)), dict(dealt(needed_part))
        none = np.empty(0, dtype=np.int64)
        rows = []
        for p in sorted({**grams, **wanted}):
            i, k = grams.get(p, none), needed[wanted.get(p, none)]
            values, which = np.unique(self.lower_prob[self.lower[at[i]]], return_inverse=True)
            split = np.unique(context[i][pieces[self.context[at[i]]] > 1])
            blocks = [
                squeeze_rising(at[i]), squeeze(context[i]), squeeze(word[i]), squeeze(times[at[i]]),
                squeeze_doubles(values), squeeze(which), squeeze_rising(k), squeeze(self.codes[k]), squeeze(split),
            ]
            rows.append((p, self.j, blocks))
        return rows

    @staticmethod
    def _part(context: np.ndarray, piece: np.ndarray, parts: int) -> np.ndarray:
        return (mix(context.astype(U) * U(0x9E3779B97F4A7C15) + piece.astype(U)) % U(parts)).astype(np.int64)

    def scores(self) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and score."""
        one, text = self.levels[0], np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = len(self.sizes)
        counts = self.word_counts[self.tokens]
        base = np.log10((counts + 1) / (one.total + one.distinct + 1))
        return {
            "n_tokens": self.sizes,
            "n_known": np.bincount(text, counts > 0, n).astype(np.int64),
            "base_score": np.bincount(text, base, n),
            "score": np.bincount(text, np.log10(self.prob)[self.gram], n),
        }


def _add_grams(parts: int, coded: bool):
    """One part of the table of an order: sums of counts, what each context keeps back, answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _all_rows(batches)
        if not asked:
            return
        p = asked[0][0]
        sizes = [int.from_bytes(b[0][:8], "little") for _, _, b in asked]
        context, word, times = (np.concatenate([unsqueeze(b[k]) for _, _, b in asked]) for k in (1, 2, 3))
        lower = np.concatenate([unsqueeze_doubles(b[4])[unsqueeze(b[5])] for _, _, b in asked])
        order = np.lexsort((word, context))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        gram = np.empty(len(order), dtype=np.int64)
        gram[order] = np.cumsum(new) - 1
        first = order[new]
        counts = np.add.reduceat(times[order], np.flatnonzero(new)) if len(order) else times
        context, word, lower = context[first], word[first], lower[first]
        seen = np.flatnonzero(counts > 0)
        names, start, owner = np.unique(context[seen], return_index=True, return_inverse=True)
        low = np.minimum(counts[seen], HIGHEST + 1)
        kept = np.bincount(owner * (HIGHEST + 2) + low, minlength=len(names) * (HIGHEST + 2)).reshape(-1, HIGHEST + 2)
        kept, sums = kept[:, : HIGHEST + 1], np.bincount(owner, lower[seen], len(names))
        kept[:, 0] = 1  # marks a context that is known here
        least = np.minimum.reduceat(low, start) if len(names) else low

        def find(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(names):
                return np.full(len(codes), HIGHEST + 1), np.zeros((len(codes), HIGHEST + 1), np.int64), np.zeros(len(codes))
            at = np.minimum(np.searchsorted(names, codes), len(names) - 1)
            hit = names[at] == codes
            return np.where(hit, least[at], HIGHEST + 1), kept[at] * hit[:, None], sums[at] * hit

        least_of_gram = find(context)[0]
        rows = []
        for (_, j, b), own in zip(asked, _cut(gram, sizes)):
            _, n, s = find(unsqueeze(b[7]))
            codes = squeeze(own * parts + p) if coded else b""
            answer = [b[0], squeeze(counts[own]), codes, squeeze(least_of_gram[own]), b[6], squeeze(n.reshape(-1)), squeeze_doubles(s)]
            rows.append((p, j, answer, None, "answer"))
        rows.append((p, None, [squeeze(context[seen]), squeeze(word[seen]), squeeze(counts[seen])], _counts_of(counts[seen]), "grams"))
        split = np.unique(np.concatenate([unsqueeze(b[8]) for _, _, b in asked]))
        if len(split):
            m, n, s = find(split)
            rows.append((p, None, [squeeze(split), squeeze(m), squeeze(n.reshape(-1)), squeeze_doubles(s)], None, "hot"))
        yield _told(rows)

    return run


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(TOLD).parquet(path).where(F.col("kind") == kind)


def _write(told: DataFrame, label: str) -> str:
    path = new_table_path(told.sparkSession, label)
    told.write.partitionBy("kind").parquet(path)
    return path


def _sums(grams: DataFrame, n: int) -> list[int]:
    """Element by element, the sums of the numbers of all parts: one row."""
    got = grams.agg(*[F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0)) for i in range(n)]).first()
    return [int(x) for x in got]


def _hot(spark: SparkSession, path: str) -> dict:
    """Totals of the split contexts, at most four rows for each part of the table."""
    out: dict[int, tuple] = {}
    for row in _stored(spark, path, "hot").select("blocks").toLocalIterator():
        codes, least, kept, sums = (f(b) for f, b in zip((unsqueeze, unsqueeze, unsqueeze, unsqueeze_doubles), row["blocks"]))
        for code, m, n, s in zip(codes.tolist(), least.tolist(), kept.reshape(-1, HIGHEST + 1), sums):
            old = out.get(code, (HIGHEST + 1, np.zeros(HIGHEST + 1), 0.0))
            out[code] = (min(old[0], m), old[1] + n, old[2] + s)
    return out


def _answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = None
    for level, path in enumerate(paths, 1):
        one = _stored(spark, path, "answer").select("j", F.lit(level).alias("level"), "blocks")
        found = one if found is None else found.unionByName(one)
    return found


@dataclass(frozen=True)
class Model:
    """A fitted model: the corpus in portions, and per order the folder of its table and its numbers."""

    portions: DataFrame
    paths: list[str]
    levels: list[Level]
    parts: int


def fit(docs: DataFrame, training: Column, order: int = ORDER) -> Model:
    """Count the n-grams of the rows of ``docs`` (``doc_id``, ``text``) for which ``training`` holds.

    The tables are parquet folders, a row per part: ``kind=grams`` holds the n-grams with their counts.
    Rows for which ``training`` is null are not learned from; a null or empty text has one token, the
    end; repeated rows count each; other columns may have any name.
    """
    spark = docs.sparkSession
    flag = F.coalesce(training, F.lit(False))
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), flag.alias("trained"), "text").mapInArrow(_read, PORTIONS)
    cut = materialize(read, "portions")
    n_tokens = cut.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // PART_TOKENS))
    asked = cut.select("j", "trained", "sizes", "tokens", "words").mapInArrow(_ask_words(parts), ASKS)
    paths = [_write(asked.repartitionById(parts, F.col("p")).mapInArrow(_add_words(parts), TOLD), "words")]
    *n, total, distinct = _sums(_stored(spark, paths[0], "grams"), HIGHEST + 4)
    d, used = discounts(n)
    back = sum(r * n[r] * (1 - d[r]) for r in range(1, HIGHEST + 1))
    out_of = total + (back <= 0)
    levels = [Level(d, used, total, out_of, distinct, (back if back > 0 else 1) / out_of)]
    share = max(1, total // (2 * parts))
    for m in range(2, order + 1):

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for row in left.to_pylist():
                portion = Portion(row, right.to_pylist(), levels)
                portion.step()
                rows += portion.asks(parts, share)
            return _ask_rows(rows)

        asked = _grouped(cut).cogroup(_answers(spark, paths).groupBy("j")).applyInArrow(ask, ASKS)
        told = asked.repartitionById(parts, F.col("p")).mapInArrow(_add_grams(parts, m < order), TOLD)
        paths.append(_write(told, f"grams{m}"))
        d, used = discounts(_sums(_stored(spark, paths[-1], "grams"), HIGHEST + 2))
        levels.append(Level(d, used, hot=_hot(spark, paths[-1])))
    return Model(cut, paths, levels, parts)


def _grouped(cut: DataFrame):
    return cut.select("j", "ids", "trained", "n_words", "sizes", "tokens").groupBy("j")


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scores(model: Model) -> DataFrame:
    """Per row of the documents the model was fitted with: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the log10 probability under add-one smoothed single words, ``score`` the model's.
    An empty table gives no rows; with nothing to learn from, every token is unknown and has probability one.
    """
    levels = model.levels

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            got = Portion(row, right.to_pylist(), levels).scores()
            got = {"doc_id": pa.array(row["ids"], pa.int64()), "train_tokens": np.full(len(row["ids"]), levels[0].total)} | got
            out.append(pa.table({n: got[n] for n in (c.split()[0] for c in SCORES.split(", "))}))
        return pa.concat_tables(out)

    answers = _answers(model.portions.sparkSession, model.paths)
    return _grouped(model.portions).cogroup(answers.groupBy("j")).applyInArrow(run, SCORES)


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model learned from those that are not held out; a null id is neither."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = scores(fit(table(spark, sf_dir, "documents"), remainder != 2))
    return got.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
