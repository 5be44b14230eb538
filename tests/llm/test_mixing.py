from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.llm import mixing
from tests.llm.tables import corpus, frame


def test_rows_and_copies(spark):
    docs = frame(spark, corpus()).selectExpr("*", "1 as rate", "2 as copy", "3 as weight")
    mixed = mixing.mix(docs, scale=3.0).drop("_order").collect()
    per = Counter((r.doc_id, r.source, r.text) for r in mixed)
    assert len(mixed) and all(set(r.asDict()) == {*docs.columns, "_copy"} for r in mixed)
    twice = [r for r, n in Counter(map(tuple, corpus())).items() if n > 1]
    for doc_id, text, _, source, _ in corpus():
        n = per.get((doc_id, source, text), 0)
        copies = sorted(r._copy for r in mixed if (r.doc_id, r.source, r.text) == (doc_id, source, text))
        times = 3 if any(t[0] == doc_id for t in twice) else 1
        assert copies == sorted(list(range(1, n // times + 1)) * times)
    assert mixing.mix(docs.where("false")).collect() == []


def test_same_copies_however_the_input_is_split(spark):
    docs = frame(spark, corpus())
    pick = lambda df: sorted(map(str, mixing.mix(df, scale=2.0).select("doc_id", "_copy", "_order").collect()))
    assert pick(docs) == pick(docs.repartition(2, "text"))


@pytest.mark.parametrize("mean", [0.3, 5.0, 63.0, 640.0])
def test_distribution(spark, mean):
    """Mean and variance of the draws, also where several draws are added up."""
    rates = mixing.with_distribution(spark.range(1).select(F.lit(mean).alias("rate")))
    draws = spark.range(4000).crossJoin(F.broadcast(rates)).select(
        mixing.copies_of(F.col("id").cast("string"), *map(F.col, ("rate", "parts", "below"))).alias("n")
    )
    got = draws.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(got[0] - mean) < 5 * math.sqrt(mean / 4000)
    assert abs(got[1] / mean - 1) < 0.15


def test_targets(spark):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["big"] * 3000 + ["small"] * 300 + [None] * 300 + ["unwanted"] * 300)]
    docs = frame(spark, rows)
    targets = spark.createDataFrame([("big", 1.0), ("small", 2.0), (None, 1.0), ("absent", 4.0), ("unwanted", -1.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix(docs, targets).collect())
    assert set(got) == {"big", "small", None}
    total = 3900
    for source, share in (("big", 0.25), ("small", 0.5), (None, 0.25)):
        assert abs(got[source] - share * total) < 6 * math.sqrt(share * total)
    assert mixing.mix(docs, targets.where("false")).collect() == []


def test_order_is_not_the_input_order(spark):
    docs = frame(spark, [(i, "t", "en", "a", 1) for i in range(500)])
    ids = [r.doc_id for r in mixing.mix(docs).collect()]
    assert ids != sorted(ids)


def test_names_of_the_operator_may_be_columns(spark):
    names = ("_n", "_parts", "_rate", "_below", "_source", "_row")
    docs = frame(spark, [(i, f"t{i}", "en", "ab"[i % 2], 1) for i in range(50)]).selectExpr("*", *[f"doc_id * 2 as {n}" for n in names])
    got = mixing.replicate(docs)
    rows = got.collect()
    assert got.columns == docs.columns and rows and all(r[n] == 2 * r.doc_id for r in rows for n in names)
    with pytest.raises(ValueError, match="_copy"):
        mixing.mix(docs.withColumn("_copy", F.lit(1)))
    assert sorted(map(tuple, mixing.replicate(docs.withColumn("_copy", F.lit(1))).drop("_copy").collect())) == sorted(map(tuple, rows))
