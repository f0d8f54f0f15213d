"""Event tables kept by day: a range of time reads its days only, and a merge rewrites only the days that it changes.

A table is Parquet in folders ``day=YYYY-MM-DD`` (the first ten letters of ``ts``, or of ``ts_start`` where there is none; ``none`` for an empty one), each
sorted by time. A merge looks up the stored days of the new keys in the key column alone, writes the changed days beside
the table, and then puts them in place. A run that dies before the new days are whole leaves the table as it was; one
that dies later is finished by the next ``recover`` or ``merge``.

Edge cases: null times go to day ``none``; keys are not null and stand once in the new rows; an empty table or no new
rows are fine; a day that loses all its rows is removed; columns named ``day`` are replaced by the table's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

DAY = "day"


def time_of(rows: DataFrame) -> str:
    """The column that gives a row its day: ``ts`` of events, ``ts_start`` of windows."""
    return "ts" if "ts" in rows.columns else "ts_start"


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DAY, F.coalesce(F.nullif(F.substring(time_of(rows), 1, 10), F.lit("")), F.lit("none")))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows with their ``day``; filters on it choose folders. ``schema`` is that of the rows without it."""
    own = T.StructType([f for f in schema.fields if f.name != DAY] + [T.StructField(DAY, T.StringType())])
    return spark.read.schema(own).parquet(path)


def write(rows: DataFrame, path: str, changed_only: bool = False) -> None:
    """Rows with a ``day`` by day; ``changed_only`` leaves the days that have none of them.

    Days are joined into files of a useful size, and a large day is dealt over many tasks.
    """
    rows = rows.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, time_of(rows))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if changed_only else "static").partitionBy(DAY).parquet(path)


def recover(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Finish a merge that had written its days, forget one that had not."""
    beside, named = f"{path}_changed", f"{path}_changed_days"
    if shared.exists(spark, f"{beside}/_SUCCESS"):
        rows = read(spark, beside, schema)
        write(rows, path, changed_only=True)
        listed = spark.read.schema("day string").json(named)
        for r in listed.join(rows.select(DAY).distinct(), DAY, "left_anti").collect():
            shared.drop(spark, f"{path}/{DAY}={r[DAY]}")
        shared.drop(spark, f"{beside}/_SUCCESS")
    shared.drop(spark, beside)
    shared.drop(spark, named)


def merge(spark: SparkSession, path: str, fresh: DataFrame, key: str) -> dict[str, int]:
    """Put ``fresh`` into the table, in place of rows of the same ``key``. ``fresh`` is read several times.

    Returns how many days were rewritten, of how many. The days pass through the driver: one row each.
    """
    schema, fresh = T.StructType([f for f in fresh.schema.fields if f.name != DAY]), with_day(fresh)
    recover(spark, path, schema)
    if not shared.exists(spark, path):
        write(fresh, path)
        n = read(spark, path, schema).select(DAY).distinct().count()
        return {"days": n, "days_rewritten": n}
    old = read(spark, path, schema)
    return replace(spark, path, old.select(key, DAY).join(fresh.select(key), key, "left_semi"), fresh, key)


def replace(spark: SparkSession, path: str, gone: DataFrame, fresh: DataFrame, key: str) -> dict[str, int]:
    """Take the rows of ``gone`` (``key``, ``day``) and of the keys of ``fresh`` out of the table, and put ``fresh`` (with its ``day``) in.

    A key of ``fresh`` that the table has on a day of its own must be in ``gone``. Both are read several times.
    """
    schema = T.StructType([f for f in fresh.schema.fields if f.name != DAY])
    old = read(spark, path, schema)
    days = fresh.select(DAY).union(gone.select(DAY)).distinct()
    days.coalesce(1).write.mode("overwrite").json(f"{path}_changed_days")
    changed = sorted(r[DAY] for r in spark.read.schema("day string").json(f"{path}_changed_days").collect())
    kept = old.filter(F.col(DAY).isin(changed)).join(gone.select(key).union(fresh.select(key)), key, "left_anti")
    write(kept.unionByName(fresh), f"{path}_changed")
    recover(spark, path, schema)
    return {"days": read(spark, path, schema).select(DAY).distinct().count(), "days_rewritten": len(changed)}
