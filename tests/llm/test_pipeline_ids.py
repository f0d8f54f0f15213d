"""Ids that stand for several texts, reruns, and what the pipeline leaves behind."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm.common import checkpoint_dir

D = "/root/testdata/sf0.001"


def folders(spark):
    path = checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(path) if f.startswith("pipeline-")}


def test_texts_of_one_id_are_kept_in_any_order(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("length(text) > 300").orderBy("doc_id").limit(12)
    twins = docs.limit(4).withColumn("text", F.concat(F.lit("quite another text about "), F.reverse("text")))
    odd = twins.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    whole = docs.unionByName(twins).unionByName(docs.limit(3)).unionByName(odd).unionByName(odd)
    told = corpus_pipeline.identified(whole)
    assert told.select("_id").distinct().count() == told.select("doc_id", "text", "source").distinct().count() == 17
    kept = [sorted((r.doc_id or -1, r.text, r.lang, r.source) for r in corpus_pipeline.drop_near_copies(spark, w, D).collect()) for w in (whole, whole.orderBy(F.desc("text")).repartition(3))]
    # The nameless copy of a twin is a near copy of it; of the two, one stays.
    assert kept[0] == kept[1] and len(kept[0]) == 16
    assert {t for _, t, _, _ in kept[0]} == {r.text for r in whole.select("text").distinct().collect()}


def test_reruns_agree_and_nothing_is_left(spark, tmp_path, monkeypatch):
    before = folders(spark)
    runs = [Counter(map(tuple, corpus_pipeline.run(spark, D).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and sum(runs[0].values()) > 100 and folders(spark) == before

    def broken(spark, docs, sf_dir):
        raise RuntimeError("a stage that fails")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("broken", broken), corpus_pipeline.STAGES[-1]])
    with pytest.raises(RuntimeError, match="fails"):
        corpus_pipeline.run(spark, D)
    assert folders(spark) == before
