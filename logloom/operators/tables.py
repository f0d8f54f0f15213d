"""The exact path over the event table: lookups, counts, top lists, ranges, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .days import DAY


def upsert(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row written of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(sequence)))).filter("_rn = 1").drop("_rn", sequence)


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.min("ts"), F.lit("")).alias("ts_min"), F.coalesce(F.max("ts"), F.lit("")).alias("ts_max"))


def top(events: DataFrame, column: str, limit: int = 10, status: str | None = None) -> DataFrame:
    rows = events.filter(F.col(column) != "") if column != "action" else events
    rows = rows.filter(F.col("status") == status) if status else rows
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failure").alias("failures")).orderBy(F.desc("n"), column).limit(limit)


def between(events: DataFrame, start: str, end: str, limit: int = 500, **equal: str | None) -> DataFrame:
    """Events of a span of time, in order. Of a table kept by day (``days``) only the days of the span are read."""
    rows = events.filter(F.col("ts").between(start, end))
    if DAY in events.columns:
        rows = rows.filter(F.col(DAY).between(start[:10], end[:10]))
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value) if value else rows
    return rows.orderBy("ts", "event_id").limit(limit)


def by_ids(rows: DataFrame, key: str, ids: list[str] | DataFrame) -> DataFrame:
    """Rows of the ids: of a short list by a filter that the scan sees, of a table (its ``key``) by a semi join.

    The join is broadcast only where the table's size is known to be under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key), key, "left_semi").select(*rows.columns)
    return rows.filter(F.col(key).isin(sorted({i for i in ids if i})))


def failure_pct(events: DataFrame) -> DataFrame:
    return events.agg(F.round(100.0 * F.count_if(F.col("status") == "failure") / F.greatest(F.count("*"), F.lit(1)), 6).alias("failure_pct"))


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet done: the resume step before an expensive operator."""
    return rows.join(done.select(key), key, "left_anti")
