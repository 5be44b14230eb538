from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from askloom.llm import quality
from tests.llm.tables import corpus, frame


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.op8_quality_classifier(spark, big).toPandas()
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    held = labels[labels.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    order = held.score.rank()
    good, bad = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (order[held.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_and_metadata_change_nothing(spark):
    docs = frame(spark, corpus())
    labels = [(d, d % 2) for d, *_ in corpus() if d is not None]
    turned = [(d, q if zlib.crc32(str(d).encode()) % 5 else 1 - q) for d, q in labels]
    schema = "doc_id bigint, quality int"
    a = quality.train(quality.described(docs), spark.createDataFrame(labels, schema))
    b = quality.train(quality.described(docs.selectExpr("doc_id", "text", "'x' as lang")), spark.createDataFrame(turned, schema))
    x = np.random.default_rng(0).normal(size=(50, len(quality.STATISTICS))).astype(np.float32)
    assert np.allclose(a.margin(x), b.margin(x))


def test_odd_rows_and_tables(spark):
    docs = frame(spark, corpus()).selectExpr("*", "1 as x", "2 as score")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    forest = quality.train(quality.described(docs), none)
    got = quality.scored(quality.described(docs), forest).collect()
    assert len(got) == len(corpus()) and {r.score for r in got} == {0.5}
    assert quality.accept(docs, none).columns == docs.columns
    assert quality.accept(docs.where("false"), none).collect() == []
    odd = spark.createDataFrame([(1, 7), (2, None), (None, 1), (10**9, 1)], "doc_id bigint, quality int")
    assert quality.train(quality.described(docs), odd).margin(np.zeros((1, len(quality.STATISTICS)))).shape == (1,)


def test_statistics_of_empty_and_split_batches():
    texts = ["A b. C", None, "", "x", "word word word\nword word word", "#a $b 12 é"]
    whole = quality.statistics(pa.array(texts))
    assert np.isfinite(whole).all() and not whole[1].any() and not whole[2].any()
    apart = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, apart)
    assert np.allclose(quality.statistics(pa.array(["zzz", *texts]).slice(1)), whole)
    place = {s: i for i, s in enumerate(quality.STATISTICS)}
    assert whole[4, place["distinct"]] == pytest.approx(1 / 6) and whole[4, place["same_lines"]] == pytest.approx(0.5)
    assert whole[0, place["upper"]] == pytest.approx(2 / 3)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality.STATISTICS))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += forest.rate * v[node - len(f)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.97
    one = quality.fit(x, np.ones(500))
    assert one.score(x).min() > 0.99
