from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import katz
from askloom.llm.blocks import spelled, squeeze, squeeze_doubles, squeeze_rising, unsqueeze, unsqueeze_doubles, unsqueeze_rising
from tests.llm.tables import corpus, frame, words

START, END, UNKNOWN = "<start>", "<end>", "<unknown>"


class Plain:
    """The same model by dictionaries and recursion."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            line = [START, *words(text, True), END]
            for i in range(1, len(line)):
                for m in range(1, order + 1):
                    if m <= i + 1:
                        self.counts[m][tuple(line[i - m + 1 : i + 1])] += 1
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for m in range(1, order + 1):
            for gram, c in self.counts[m].items():
                self.after[m][gram[:-1]][gram[-1]] = c
        self.d = [None] + [self.discounts(Counter(c.values())) for c in self.counts[1:]]
        self.vocabulary = [w for (w,) in self.counts[1]]
        self.total = sum(self.counts[1].values())

    @staticmethod
    def discounts(n):
        for k in (5, 4, 3, 2, 1):
            if all(n[r] for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                d = {r: (((r + 1) * n[r + 1] / n[r]) / r - a) / (1 - a) if a < 1 else 0 for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
        return {r: 1 - 0.5 / r for r in range(1, 6)}

    def shares(self, context):
        """Probabilities of the words seen after a context, and what is kept back."""
        m = len(context) + 1
        seen = self.after[m][context]
        total = sum(seen.values())
        back = sum((1 - self.d[m].get(c, 1)) * c for c in seen.values())
        if not any(c in self.d[m] for c in seen.values()):
            total, back = total + 1, 1
        return {w: self.d[m].get(c, 1) * c / total for w, c in seen.items()}, back / total

    def prob(self, word, context):
        if context and context not in self.after[len(context) + 1]:
            return self.prob(word, context[1:])
        seen, back = self.shares(context)
        if word in seen:
            return seen[word]
        if not context:
            return back
        return back / (1 - sum(self.prob(w, context[1:]) for w in seen)) * self.prob(word, context[1:])

    def score(self, text):
        line = [START, *words(text, True), END]
        return sum(math.log10(self.prob(line[i], tuple(line[max(0, i - self.order + 1) : i]))) for i in range(1, len(line)))


def texts_of(seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(160):
        n = rng.randint(0, 25)
        out.append(" ".join(f"w{min(int(rng.expovariate(0.12)), 60)}" + ("" if rng.random() < 0.95 else str(rng.random())) for _ in range(n)))
    return out + ["the cat"] * 9 + ["The  CAT sat\non it", None, "", " \t ", "é Ä ß", "x" * 9000, "a b " * 800]


def expected(rows, order):
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    model = Plain(learned, order)
    out = []
    for i, t in rows:
        line = [*words(t, True), END]
        c = [model.counts[1][(w,)] for w in line]
        base = sum(math.log10((x + 1) / (model.total + len(model.vocabulary) + 1)) for x in c)
        out.append((i, len(line), sum(x > 0 for x in c), model.total, base, model.score(t)))
    return out


def run(spark, rows, order, parts=None):
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows]).selectExpr("*", "1 as trained", "2 as j", "3 as p")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return katz.scores(katz.fit(docs, remainder != 2, order))


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want):
        assert np.allclose(a[4:], b[4:], rtol=1e-9), (a, b)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_recursion(spark, order):
    rows = list(enumerate(texts_of())) + [(None, "w1 w2 w3"), (3, "w1 w1"), (3, "w1 w1")]
    same(run(spark, rows, order).collect(), expected(rows, order))


def test_portions_and_split_contexts(spark, monkeypatch):
    """Many small portions, and one word that follows and leads all others."""
    monkeypatch.setattr(katz, "PORTION", 2000)
    rng = random.Random(5)
    rows = [(i, " ".join(x for _ in range(30) for x in ("the", f"w{rng.randrange(400)}"))) for i in range(60)]
    same(run(spark, rows, 2).collect(), expected(rows, 2))


def test_counts_without_low_ones(spark):
    """Every n-gram is frequent, so nothing would be kept back: held-out texts still get a probability."""
    rows = [(i, "a b c") for i in range(100)] + [(i, "b a zz") for i in range(100, 140)][::7]
    got = run(spark, rows, 3).collect()
    same(got, expected(rows, 3))
    assert all(math.isfinite(r.score) for r in got)


def test_sums_to_one():
    model = Plain([t for t in texts_of() if t], 3)
    for context in [(), ("w1",), ("w2", "w3"), (START,), (START, "w1")]:
        context = context if not context or context in model.after[len(context) + 1] else ()
        assert abs(sum(model.prob(w, context) for w in [*model.vocabulary, UNKNOWN]) - 1) < 1e-9


def test_empty_and_untrained(spark):
    assert run(spark, [], 2).collect() == []
    docs = frame(spark, [(1, "a b", None, None, None), (2, None, None, None, None)])
    got = katz.scores(katz.fit(docs, F.lit(False))).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]


def test_blocks():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), np.zeros(5, np.int64), rng.integers(0, 2**50, 1000)):
        assert (unsqueeze(squeeze(values)) == values).all()
        assert (unsqueeze_rising(squeeze_rising(np.sort(values))) == np.sort(values)).all()
    assert list(unsqueeze_doubles(squeeze_doubles(np.array([1.5, -2])))) == [1.5, -2]


def test_spelling():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    for part in (texts, texts[3:90], []):
        codes, found, bounds = spelled(pa.array(texts, pa.string()).slice(3, 87) if part == texts[3:90] else pa.array(part, pa.string()), katz.WORD)
        found = [w.decode() for w in found.to_pylist()]
        got = [[found[c] for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [words(t, True) for t in part]


def test_model_beats_single_words(spark, sf_dir):
    got = katz.op11_katz_scores(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in got)
