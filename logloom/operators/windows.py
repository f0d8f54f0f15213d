"""Incident windows: events of an actor and address without a long gap, cut to a size, with a risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import RISK_WEIGHTS, is_root, render_line
from ..shared import cut
from . import cuts

KEY = ["source", "principal", "src_ip"]
#: Rows of a key beyond which it is worked on hour by hour and its sessions are cut in blocks.
HOT_KEY = 20_000


def risk(actions: Column, failures: Column, root: Column, weights: dict[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    known = F.aggregate(F.transform(F.array_distinct(actions), lambda a: F.coalesce(F.try_element_at(table, a), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.least(F.lit(100), known + F.least(F.lit(30), 2 * failures) + F.when(root, 25).otherwise(0)).cast("int")


FIELDS = ["ts", "event_id", "action", "status", "principal", "src_ip", "resource", "region", "account_id", "source"]


def pauses(rows: DataFrame, keys: list[str], gap_minutes: int) -> DataFrame:
    """``rows`` with ``_at``, ``_new`` (a pause lies before the row) and ``_in`` (pauses so far) within ``keys``."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    rows = rows.withColumn("_at", F.unix_timestamp(F.try_to_timestamp("ts")))
    rows = rows.withColumn("_new", (F.coalesce(F.col("_at") - F.lag("_at").over(order), F.lit(0)) > gap_minutes * 60).cast("int"))
    return rows.withColumn("_in", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def by_hour(rows: DataFrame, gap_minutes: int) -> DataFrame:
    """``rows`` with ``_group``, the number of the session within its key, and within the session the position ``i`` and the
    running size ``total``, for keys too large for one task.

    A key is worked on hour by hour. What an hour hands on is a row for each of its sessions.
    """
    hour = [*KEY, "_hour"]
    rows = pauses(rows.withColumn("_hour", F.substring("ts", 1, 13)), hour, gap_minutes)
    hours = Window.partitionBy(*KEY).orderBy("_hour")
    each = rows.groupBy(*hour).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.sum("_new").alias("pauses"))
    apart = (F.coalesce(F.col("first") - F.lag("last").over(hours), F.lit(0)) > gap_minutes * 60).cast("int")
    each = each.withColumn("_step", F.coalesce(F.lag("pauses").over(hours), F.lit(0)) + apart)
    base = each.select(*hour, F.sum("_step").over(hours.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_base"))
    rows = rows.join(base, hour).withColumn("_group", F.col("_base") + F.col("_in")).drop("_at", "_new", "_in", "_base")
    part = [*KEY, "_group", "_hour"]
    order = Window.partitionBy(*part).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*KEY, "_group").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part).agg(F.count("*").alias("n"), F.sum("_chars").alias("c"), F.min("ts").alias("f"))
    sums = sums.select(*part, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in ("n", "c")), F.min("f").over(Window.partitionBy(*KEY, "_group")).alias("_first"))
    rows = rows.withColumns({"_i": F.count("*").over(order), "_s": F.sum("_chars").over(order)}).join(sums, part)
    return rows.withColumns({"i": F.col("_i") + F.col("_n"), "total": F.col("_s") + F.col("_c")}).drop("_hour", "_i", "_s", "_n", "_c")


def split(e: Column, max_chars: int, max_events: int) -> Column:
    """The pieces ``p, e`` of a session's sorted events, cut greedily in one fold over their sizes."""
    size = lambda x: F.length(x["line"]) + 3
    state = lambda chars, n, at, starts: F.struct(chars.cast("long").alias("chars"), n.alias("n"), at.alias("at"), starts.alias("starts"))

    def step(s: Column, x: Column) -> Column:
        new = (s["at"] > 0) & ((s["chars"] + size(x) > max_chars) | (s["n"] >= max_events))
        return state(F.when(new, 0).otherwise(s["chars"]) + size(x), F.when(new, 1).otherwise(s["n"] + 1), s["at"] + 1, F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]))
    whole = (F.size(e) <= max_events) & (F.aggregate(e, F.lit(0), lambda n, x: n + size(x)) <= max_chars)
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.aggregate(e, state(F.lit(0), F.lit(0), F.lit(0), F.array(F.lit(0))), step, lambda s: s["starts"]))
    bound = F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: F.struct(k.alias("p"), F.slice(e, at + 1, F.coalesce(F.get(s, k + 1), F.size(e)) - at).alias("e"))))
    return F.get(bound, 0)


def cut_sessions(rows: DataFrame, gap_minutes: int, max_chars: int, max_events: int, hot_key: int, block: int) -> DataFrame:
    """``KEY, _group, _first, p, e``: the pieces of all sessions with their sorted events.

    Keys of more than ``hot_key`` rows are counted first (narrow counts, added up where the rows are read). All others move
    once, by key; a session of theirs is one array, cut in one fold.
    """
    hot = rows.groupBy(*KEY).count().filter(F.col("count") > hot_key).select(*KEY)
    names, one = [*KEY, "_group", "_first", "p", "e"], F.struct(*FIELDS, "line")

    def plain(part: DataFrame) -> DataFrame:
        part = pauses(part, KEY, gap_minutes).withColumnRenamed("_in", "_group").groupBy(*KEY, "_group").agg(F.array_sort(F.collect_list(one)).alias("e"))
        return part.select(*KEY, "_group", F.get("e", 0)["ts"].alias("_first"), F.explode(split(F.col("e"), max_chars, max_events)).alias("x")).select(*KEY, "_group", "_first", "x.p", "x.e")
    if hot.isEmpty():
        return plain(rows)
    long = by_hour(rows.join(hot, KEY, "left_semi").withColumn("_chars", (F.length("line") + 3).cast("long")), gap_minutes).withColumn("chars", F.col("_chars"))
    long = cuts.pieces(long, [*KEY, "_group"], max_chars, max_events, block).groupBy(*KEY, "_group", "_first", F.col("_piece").cast("int").alias("p")).agg(F.array_sort(F.collect_list(one)).alias("e"))
    return plain(rows.join(hot, KEY, "left_anti")).select(*names).unionByName(long.select(*names))


def build_windows(events: DataFrame, gap_minutes: int = 15, max_chars: int = 4800, max_events: int = 120, weights: dict[str, int] | None = None, preserve_case: bool = False,
                  start_index: int = 1, hot_key: int = HOT_KEY, block: int = cuts.BLOCK, by_content: bool = False) -> DataFrame:
    """Windows of deduplicated events, numbered from ``start_index`` by the first time of their session.

    With ``by_content`` a window's id is a hash of its events instead, the same whatever other windows there are, no row moves a
    second time, and ``session_start`` is added.

    Rows move once by key and once, as windows, by the minute in which their session begins; a window gathers
    ``max_events`` rows at most. A window's number is its rank in that minute plus the windows of the minutes before, which
    are narrow counts. Sessions of any length are cut by many tasks (``cuts``).
    """
    line = render_line({c: F.col(c) for c in FIELDS})
    found = cut_sessions(events.select(*FIELDS).withColumn("line", line), gap_minutes, max_chars, max_events, hot_key, block)
    if by_content:
        rows = found.withColumn("chunk_id", F.concat(F.lit("w-"), F.substring(F.sha2(F.to_json("e"), 256), 1, 24))).withColumnRenamed("_first", "session_start")
    else:
        # Counted and ranked below: worked out once.
        found = cut(found.withColumn("_minute", F.substring("_first", 1, 16)))
        before = found.groupBy("_minute").count().select("_minute", F.coalesce(F.sum("count").over(Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        rank = F.row_number().over(Window.partitionBy("_minute").orderBy("_first", *KEY, "_group", "p"))
        rows = found.withColumn("_rank", rank).join(before, "_minute").withColumn("chunk_id", F.format_string("w-%05d", F.col("_before") + F.col("_rank") + (start_index - 1)))

    field = lambda name: F.transform("e", lambda x: x[name])
    failures = F.size(F.filter("e", lambda x: x["status"] == "failure"))
    rows = rows.select(
        "chunk_id", F.array_min(field("ts")).alias("ts_start"), F.array_max(field("ts")).alias("ts_end"), *KEY, F.size("e").alias("n_events"), failures.alias("n_failures"),
        F.array_sort(F.array_distinct(field("action"))).alias("event_names"), field("event_id").alias("event_ids"),
        risk(field("action"), failures, F.exists("e", lambda x: is_root(x["principal"])), weights or RISK_WEIGHTS).alias("risk_score"),
        F.array_sort(F.array_distinct(F.filter(field("account_id"), lambda x: x != ""))).alias("accounts"), *(["session_start"] if by_content else []), "e")
    header = F.format_string("[WINDOW %s] %s -> %s | source=%s | principal=%s | src_ip=%s | events=%d | failures=%d | risk=%d", "chunk_id", "ts_start", "ts_end", "source",
                             *(F.when(F.col(c) == "", "-").otherwise(F.col(c)) for c in ("principal", "src_ip")), "n_events", "n_failures", "risk_score")
    lead = F.concat_ws(" ", "source", "principal", "src_ip", F.array_join("event_names", " "), F.array_join("accounts", " "))
    words = F.flatten(F.transform("e", lambda x: F.array(
        *(x[c] for c in ("action", "principal", "src_ip", "resource", "region", "event_id")), F.when(x["status"] == "failure", "failure failed error denied"))))
    search = F.concat_ws(" ", lead, F.filter(words, lambda x: x != ""))
    return rows.withColumn("text", F.concat_ws("\n", header, F.transform("e", lambda x: F.concat(F.lit("- "), x["line"])))).withColumn(
        "search_text", search if preserve_case else F.lower(search)).drop("e")


def membership(windows: DataFrame) -> DataFrame:
    return windows.select("chunk_id", F.posexplode("event_ids").alias("position", "event_id")).select("chunk_id", "event_id", "position")


def events_of_window(windows: DataFrame, events: DataFrame, chunk_id: str) -> DataFrame:
    return membership(windows.filter(F.col("chunk_id") == chunk_id)).join(events, "event_id").orderBy("position")


def by_source(windows: DataFrame) -> DataFrame:
    return windows.groupBy("source").agg(F.count("*").alias("windows"), F.sum("n_events").alias("events")).orderBy("source")


def summarize(windows: DataFrame, high: int = 50) -> DataFrame:
    return windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("events"), F.coalesce(F.sum("n_failures"), F.lit(0)).alias("failures"),
                       F.count_if(F.col("risk_score") >= high).alias("high_risk"), F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_risk"), F.coalesce(F.max("n_events"), F.lit(0)).alias("max_events"))


def sizes(windows: DataFrame) -> DataFrame:
    return windows.agg(F.coalesce(F.percentile("n_events", 0.5), F.lit(0.0)).alias("p50"), F.coalesce(F.percentile("n_events", 0.9), F.lit(0.0)).alias("p90"))
