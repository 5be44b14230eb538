"""The pipeline against the same steps done by brute force, stage by stage."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from askloom.llm import mixing
from askloom.llm.bpe import Bpe, vocabulary
from tests.llm.tables import corpus, frame
from tests.llm.test_near_duplicates import expected as near
from tests.llm.test_substring_dedup import expected as passages

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    frame(spark, corpus()).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 0 if t and t.startswith("same same") else 1) for d, t, *_ in corpus() if d is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "mixing", "tokens"]
    rows = [tuple(r) for r in docs.collect()]
    kept = stages["quality"](spark, docs, folder)
    good = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and not Counter(good) - Counter(rows)
    one = stages["near_dedup"](spark, frame(spark, good), folder)
    groups = near(good)
    unique = [r for r in good if r[0] is None or groups[r[0]][2]]
    assert one.columns == docs.columns and Counter(map(tuple, one.collect())) == Counter(unique)
    cut = stages["substring_dedup"](spark, frame(spark, unique), folder)
    texts = sorted((str(d), t if n else None) for d, _, n, t in passages(unique, 50))
    raw = {str(r[0]): r[1] for r in unique}
    assert cut.columns == docs.columns
    assert sorted(map(str, ((str(r.doc_id), r.text) for r in cut.collect()))) == sorted(
        str((d, raw[d] if t is None else t)) for d, t in texts
    )
    cut_rows = [tuple(r) for r in cut.collect()]
    mixed = stages["mixing"](spark, frame(spark, cut_rows), folder)
    assert mixed.columns == docs.columns
    assert Counter(map(tuple, mixed.collect())) == Counter(
        tuple(r)[:5] for r in mixing.mix(frame(spark, cut_rows)).collect()
    )
    tokens = stages["tokens"](spark, mixed, folder).collect()
    bpe = Bpe(vocabulary())
    want = Counter((r.doc_id, tuple(bpe.encode(r.text or ""))) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens) == want
    assert all(r.n_tokens == len(r.ids) for r in tokens)
    for r in tokens[:50]:
        said = bpe.decode(np.array(r.ids, dtype=np.int64), np.array([0, len(r.ids)]))[0]
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_run_and_empty_tables(spark, folder, tmp_path):
    done = pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and done.count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
