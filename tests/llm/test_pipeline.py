"""The pipeline against its stages' operators, one by one, and on tables that hold nothing."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from witnessframe.llm import decontaminate, minhash, mixing, quality, sharding

ROOT = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    read = spark.read.parquet
    docs, labels, bench = (read(f"{ROOT}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    out = {(r.doc_id, r.shard): n for r, n in collections.Counter(corpus_pipeline.run(spark, ROOT).select("doc_id", "shard").collect()).items()}

    scored = quality.score(docs, quality.train(docs, labels)).where("predicted = 1").select("doc_id")
    one = docs.join(scored, "doc_id", "left_semi").select(docs.columns)
    kept = minhash.near_duplicates(one).where("kept").select("doc_id")
    two = one.join(kept, "doc_id", "left_semi").select(docs.columns)
    found = decontaminate.leaks(two, bench).select("doc_id")
    three = two.join(found, "doc_id", "left_anti").select(docs.columns)
    want = {(r.doc_id, r.shard): r.copies for r in mixing.mix(three).withColumn("shard", sharding.jump(F.col("doc_id"), 8)).collect() if r.copies}
    assert out == want


def test_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), ROOT)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), ROOT).columns == [*docs.columns, "shard"]
