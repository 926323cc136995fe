"""The pipeline's stages, one by one and together."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        before, docs = docs, spark.read.parquet(f"{base}/{name}")
        out.append((name, before, docs))
    return out


def test_all_but_the_last_give_documents(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert [name for name, _, _ in stages] == ["quality_rules", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    assert all(after.dtypes == want for _, _, after in stages[:-1])


def test_decisions_take_effect(spark, stages):
    by = {name: (before, after) for name, before, after in stages}
    before, after = by["quality_rules"]
    assert 0 < after.count() < before.count() and after.join(before, before.columns).count() == after.count()
    before, after = by["simhash_near_dedup"]
    assert after.count() == after.select("doc_id").distinct().count() <= before.count()
    before, after = by["pii"]
    assert after.count() == before.count()
    assert after.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.")).count() == 0
    before, after = by["mixing"]
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert words(after) == pytest.approx(1.5 * words(before), abs=40)
    before, after = by["sentencepiece"]
    assert after.count() == before.count() and after.filter("NOT round_trip").count() == 0


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(
        map(tuple, stages[-1][2].select("doc_id", "ids_sha256").collect())
    )
