"""Stored windows brought up to changed events: only the sessions that a change can reach are built anew.

A change is a place (key and time) at which an event came, left or became another. It reaches a session of its key that
lies within a pause of it; all other sessions keep their events, as they are more than a pause away from these and from
every new event. Cuts run forward, so a reached session is built anew from its last window that begins before the first
change: an endless session that only grows costs its last window. Ids are hashes of what a window holds
(``build_windows(by_content=True)``), so windows whose events stay keep their ids, and the result is that of a full build.

Edge cases: events without a readable time stand in the first or last session of their key, which any change of the key reaches; they reach all its sessions;
changes of keys without windows reach none; no changes or no windows give none. Times compare by whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import KEY

SESSION = [*KEY, "session_start"]
HOUR = 3600


def seconds(column: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.col(column)))


def changes(fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``event_id``, key and ``ts`` of the new events and of the stored ones that they replace."""
    place = ["event_id", *KEY, "ts"]
    return fresh.select(*place) if stored is None else fresh.select(*place).unionByName(stored.select(*place).join(fresh.select("event_id"), "event_id", "left_semi"))


def reached(windows: DataFrame, changed: DataFrame, gap_minutes: int) -> DataFrame:
    """``chunk_id``, ``day``, the session and ``from`` (seconds; null for the whole session) of the stored windows to build anew.

    Sessions and changes meet by key and hour; an hour of a key holds 3,600 different seconds of changes at most.
    """
    gap, at = gap_minutes * 60, changed.select(*KEY, seconds("ts").alias("at"))
    keys = at.groupBy(*KEY).agg(F.bool_or(F.col("at").isNull()).alias("all"))
    own = windows.select("chunk_id", "day", *SESSION, seconds("ts_start").alias("s"), seconds("ts_end").alias("e")).join(keys, KEY)
    sessions = own.groupBy(*SESSION).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.bool_or(F.col("all") | F.col("s").isNull() | F.col("e").isNull()).alias("all"))
    hour = lambda c: F.floor(c / HOUR)
    near = at.filter("at is not null").groupBy(*KEY, hour(F.col("at")).alias("hour")).agg(F.collect_set("at").alias("at"))
    hours = sessions.filter(~F.col("all")).withColumn("hour", F.explode(F.sequence(hour(F.col("s") - gap), hour(F.col("e") + gap))))
    hit = hours.join(near, [*KEY, "hour"]).select(*SESSION, F.array_min(F.filter("at", lambda t: t.between(F.col("s") - gap, F.col("e") + gap))).alias("t")).filter("t is not null")
    first = hit.groupBy(*SESSION).agg(F.min("t").alias("t")).unionByName(sessions.filter("all").select(*SESSION, F.lit(None).cast("long").alias("t")))
    pieces = own.join(first, SESSION)
    restart = pieces.groupBy(*SESSION).agg(F.max(F.when(F.col("s") < F.col("t"), F.col("s"))).alias("from"))
    return pieces.join(restart, SESSION).filter(F.col("from").isNull() | (F.col("s") >= F.col("from"))).select("chunk_id", "day", *SESSION, "from")


def days_of(windows: DataFrame, changed: DataFrame) -> DataFrame:
    """The days on which events of these windows and changes can lie; null if a window's times can't be read (any day then)."""
    date = lambda c: F.to_date(F.try_to_timestamp(F.col(c)))
    spans = windows.select(F.explode_outer(F.sequence(date("ts_start"), date("ts_end"))).alias("day")).select(F.col("day").cast("string"))
    # Folders are named by the first letters of the time, also where it can't be read.
    ends = windows.select(F.explode(F.array("ts_start", "ts_end")).alias("ts")).unionByName(changed.select("ts"))
    return spans.union(ends.select(F.coalesce(F.nullif(F.substring("ts", 1, 10), F.lit("")), F.lit("none")))).distinct()


def continued(built: DataFrame, gone: DataFrame) -> DataFrame:
    """``built`` with the ``session_start`` of those sessions that were built anew from a later window only."""
    later = gone.filter("`from` is not null").select(*KEY, F.col("from").alias("_from"), F.col("session_start").alias("_begun")).distinct()
    rows = built.withColumn("_from", seconds("session_start")).join(later, [*KEY, "_from"], "left")
    return rows.withColumn("session_start", F.coalesce("_begun", "session_start")).drop("_from", "_begun").select(*built.columns)
