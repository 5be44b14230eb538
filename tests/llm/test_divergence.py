from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from askloom.llm import divergence as dv
from tests.llm.tables import UPPER, corpus, frame

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def expected(rows, least):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(UPPER))) for _, text, lang, source, _ in rows]
    held = defaultdict(Counter)
    for lang, _, w in docs:
        held[lang].update(set(w))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}
    counts = defaultdict(Counter)
    for lang, source, w in docs:
        counts[lang, source].update(t for t in w if held[lang][t] >= least)
        counts[lang, None].update(t for t in w if held[lang][t] >= least)

    def share(lang, source, t):
        c = counts[lang, source]
        return 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept[lang]))

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, source in {(a, b) for a, b, _ in docs}:
        pairs = [(-sum(f(share(lang, source, t), share(lang, o, t)) for t in kept[lang]), o) for o in {b for a, b, _ in docs if a == lang} - {source}]
        terms = [(share(lang, source, t), share(lang, None, t), t) for t in kept[lang] if counts[lang, source][t]]
        terms = sorted((-f(p, q), t.encode()) for p, q, t in terms if p > q)[:10]
        out += [(lang, source, "pair", o, -v, i) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
        out += [(lang, source, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def rows_of(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None])
        pool = [f"{x}{y}" for x in "abcdeé" for y in "klmnopqrstu"][: 60 if source != "c" else 30]
        text = " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 12)))
        rows.append((i, f"{text}-9x{'junk' * (i % 3)}{i}" if i % 5 else text, lang, source, None))
    rows += [(1000 + i, t, "zz", s, None) for i, (t, s) in enumerate([(None, "a"), ("", "b"), ("  9 ", None), ("only once", "q")])]
    return rows + [(2000, "alone here", "single", "x", None), rows[3], rows[3]]


@pytest.mark.parametrize("least, block", [(10, 128), (2, 2), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(dv, "BLOCK_GROUPS", block)
    monkeypatch.setattr(dv, "PORTION", 700)
    rows = rows_of(least)
    docs = frame(spark, rows).selectExpr("*", "1 as total", "2 as slice", "3 as block", "4 as value", "5 as rank")
    got = dv.divergence(docs, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows, least)


def test_odd_rows(spark):
    rows = corpus()
    assert sorted(map(tuple, dv.divergence(frame(spark, rows)).collect())) == expected(rows, 10)
    assert dv.divergence(frame(spark, [])).collect() == []


def test_runs_and_stretches():
    rng = np.random.default_rng(2)
    for size in (1, 7, 200):
        a, b = rng.integers(0, 3, size) * 10**8 + 1, np.sort(rng.integers(0, 3, size)) * 10**8 + 1
        assert dv.stretched(dv.runs(a), dv.runs(b), size) == int(dv.difference(a, b).sum())


def test_shares_are_exact():
    counts = np.array([0, 10**12, 3, 10**12])
    assert dv.shares(counts, 10**13, 5).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 10) for c in counts.tolist()]
