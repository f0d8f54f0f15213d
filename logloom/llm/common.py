"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    Only where that is unset and the master is a single local process (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="logloom-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files of finished steps now: Spark does so when the driver's memory is next collected, which on
    a driver with little to do may be after the job."""
    gc.collect()
    spark._jvm.System.gc()


def few(df: DataFrame, per: int) -> DataFrame:
    """``cut`` of ``df``, read back in about one partition for ``per`` rows and no more than before.

    Small frames then make few files in the shuffles that follow, whatever the number of input partitions.
    """
    df = cut(df)
    return df.coalesce(max(1, min(df.rdd.getNumPartitions(), -(-df.count() // per))))


def with_group_totals(rows: DataFrame, keys: list[str], spread_by: str, **totals: tuple[str, str]) -> DataFrame:
    """Add totals of each row's group (``name=(function, column)``; min, max, count) without gathering a group.

    Rows of a key are dealt over ``spark.sql.shuffle.partitions`` salts by ``spread_by``. Totals are taken per
    (key, salt), then per key, and go back to the rows by (key, salt), so that a key with a third of all rows
    is as many small join keys. ``rows`` is read twice: give a cheap or a checkpointed frame. Keys are not null.
    """
    merge = {"min": F.min, "max": F.max, "count": F.sum}
    first = {"min": F.min, "max": F.max, "count": F.count}
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(shuffle_parts(rows))).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*(first[f](c).alias(n) for n, (f, c) in totals.items()))
    whole = part.groupBy(*keys).agg(*(merge[f](n).alias(n) for n, (f, _) in totals.items()))
    back = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each node of an undirected graph: ``edges(u, v)`` to ``(id, component)``.

    Alternating large-star and small-star contraction, with links kept as (larger, smaller). The least neighbour of a
    node is an aggregation that combines on the map side; it is checkpointed before the large star's join, so that
    adaptive execution can split the rows of a hub. The small star groups by the larger end, which has few smaller
    neighbours. Only a count and a sum of the links come to the driver, to see that nothing moved. Few links are
    read back in few partitions.
    """
    parts = shuffle_parts(edges)

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df)
        seen = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        return df.coalesce(max(1, min(parts, -(-seen[0] // 100_000)))), seen

    now, mark = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        least = cut(now.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("least"))).coalesce(now.rdd.getNumPartitions())
        large = now.join(least, now["v"] == least["at"], "left").select("u", F.coalesce("least", "v").alias("v"))
        order = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        small = large.withColumn("low", F.first("v").over(order)).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        now, seen = kept(small.filter("u <> v").distinct())
        if seen == mark:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def bounded(sample: DataFrame, most_bytes: int) -> DataFrame:
    """``sample`` (doc_id, text and more; few rows) with at most about ``most_bytes`` of text, less by a hash of doc_id.

    A text of more than a twentieth of that isn't a row of it. Checkpointed, so the documents are read once.
    """
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = cut(sample.filter(size <= most_bytes // 20))
    total = own.agg(F.sum(size)).first()[0] or 0
    if total <= most_bytes:
        return own
    return own.filter(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1_000_000)) < 1_000_000 * most_bytes // total)


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
