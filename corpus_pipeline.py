"""From raw documents to shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``:
language ID drops what it rejects (no letter, or too far from every centroid); near-dedup keeps the smallest doc_id of
each group of documents that share at least 0.8 of their five-word shingles, once where its row repeats;
decontamination drops documents that hold a benchmark item; mixing repeats or drops documents to the sources' target
weights; sharding gives each row its shard and slot.

A document is told by its ``doc_id``. Where rows of one id differ in text or source, each such text is a document of its
own: one of them, the same in every run, goes by the id, the others by a negative number made from id, text and source.
Rows without a ``doc_id`` go by such a number, too. So rows fall away as repeated only where they agree in id, text and
source, and of these the first by all columns stays. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm import decontamination, language_id, mixing, near_dedup, sharding
from logloom.llm.common import checkpoint_dir, cut, docs_of, drop_folder


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``, the doc_id or a number below zero in its place.

    Only ids move, with a hash of their text and source, and those with several texts are joined: seldom any.
    """
    said = F.xxhash64("text", "source")
    made_up = -1 - F.pmod(F.when(F.col("doc_id").isNull(), said).otherwise(F.xxhash64("doc_id", "text", "source")), F.lit(1 << 62))
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(said).alias("_least"), F.max(said).alias("_most")).filter("_least <> _most")
    twice = cut(twice.select(F.col("doc_id").alias("_doc"), "_least"))
    if twice.isEmpty():
        return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made_up))
    rows = docs.join(twice, F.col("doc_id") == F.col("_doc"), "left")
    own = F.when(F.col("_least").isNull() | (F.col("_least") == said), F.col("doc_id").cast("long"))
    return rows.withColumn("_id", F.coalesce(own, made_up)).drop("_doc", "_least")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    return language_id.predict(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = identified(docs)
    narrow = told.select(F.col("_id").alias("doc_id"), "text", "source")
    stays = near_dedup.near_dedup(narrow, width=5, threshold=80).filter("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"))
    kept = told.join(stays, "_id")
    # Only rows that repeat are compared.
    first = F.row_number().over(Window.partitionBy("_id").orderBy(*docs.columns))
    again = kept.filter("_rows > 1").withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept.filter("_rows = 1").unionByName(again).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.scan(docs, docs_of(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = identified(docs)
    taken = mixing.mix(told.select(F.col("_id").alias("doc_id"), "text", "source")).groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0").withColumnRenamed("doc_id", "_id")
    return told.join(taken, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    topology = sharding.tree(40)
    return sharding.shard(docs, topology, sharding.grow(topology, 40))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages can't be written as SQL; a test holds run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage returns is written to the shared folder and read by the next.

    A stage's folder is deleted when the next one is written, all of them where a stage fails. The result is a checkpoint,
    so that nothing of the pipeline is left; ``run_into`` writes it elsewhere.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        return cut(_stages(spark, sf_dir, folder))
    finally:
        drop_folder(spark, folder)


def _stages(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    docs, before = docs_of(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def run_into(spark: SparkSession, sf_dir: str, path: str) -> None:
    """``run`` written to ``path``; nothing else that the stages wrote is left."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        _stages(spark, sf_dir, folder).write.parquet(path)
    finally:
        drop_folder(spark, folder)
