from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa

from askloom.llm import resampling
from tests.llm.tables import UPPER, corpus, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def expected(rows, target):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in {*s, *t}}
    out = []
    for i, text, *_ in rows:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[5] = k
    return out


def order(rows):
    return sorted([tuple(r) for r in rows], key=str)


def test_checksums():
    texts = [b"", b"a", b"abc", b"123456789", "é ü".encode(), b"x" * 70000, b"y" * 70000, b"abd"] * 3
    array = pa.array(texts, pa.large_binary())
    assert resampling.checksums(array).tolist() == [zlib.crc32(t) for t in texts]
    assert resampling.checksums(array.slice(3, 9)).tolist() == [zlib.crc32(t) for t in texts[3:12]]
    assert resampling.checksums(array[:0]).tolist() == []


def test_equals_brute_force(spark):
    rows = [(i, f"{t} W{i % 7} x{i}.y" if t else t, *rest) for i, t, *rest in corpus() if i is not None] + corpus()[-3:]
    target = ["w1 w2 w3 w4 five", None, "one TWO three w5", "é ü ß"]
    docs = frame(spark, rows).selectExpr("*", "1 as rank", "2 as weight", "3 as _at", "4 as buckets")
    got = resampling.draw(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got.columns == names
    want = expected(rows, target)
    assert order(got.collect()) == order(want)
    assert sum(r[5] is not None for r in want) > 3


def test_slices_do_not_matter(spark, monkeypatch):
    rows = corpus(7)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    whole = order(resampling.draw(frame(spark, rows), target).collect())
    monkeypatch.setattr(resampling, "SLICE", 500)
    monkeypatch.setattr(resampling, "MATRIX", 64)
    assert order(resampling.draw(frame(spark, rows), target).collect()) == whole


def test_empty_tables(spark):
    none = frame(spark, [])
    assert resampling.draw(none, none).collect() == []
    rows = [(i, "a b " * 30, None, None, None) for i in range(40)]
    assert order(resampling.draw(frame(spark, rows), none).collect()) == order(expected(rows, []))
