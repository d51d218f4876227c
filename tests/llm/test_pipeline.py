from __future__ import annotations

import os

import pytest
from helpers import frame, odd_rows

pytest.importorskip("public_tokenizers")
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark, tmp_path):
    docs = frame(spark, odd_rows()).unionByName(spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    count = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert 0 < docs.count() <= count
            count = docs.count()
    assert docs.select("doc_id").distinct().count() <= count


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_of_an_empty_table(spark):
    docs = frame(spark, odd_rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
