"""Beyond the stored tables: retrieval metrics, redaction, citation checks, questions taken apart, detectors of attacks."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import is_root

#: Shapes of secrets in log text, with what replaces them.
REDACTIONS = [(r"(AKIA|ASIA)[0-9A-Z]{16}", "[ACCESS_KEY]"), (r"(?i)bearer +[a-z0-9._-]{8,}", "[BEARER]"), (r"(?i)password=[^ ]+", "password=[REDACTED]")]

#: Shapes that are cited: an address, and an event or a window.
MAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
CITED = r"\[(?:event|window):([^\]]+)\]"


def redact(text: Column, more: list[tuple[str, str]] = []) -> Column:
    """``text`` without secrets, and without ``more`` shapes, each with its mark."""
    for shape, mark in REDACTIONS + more:
        text = F.regexp_replace(text, shape, F.lit(mark))
    return text


def recall_mrr(hits: DataFrame, truth: DataFrame, key: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at each k and the reciprocal rank of the first true hit; ``hits``: key, rank; ``truth``: key."""
    true = hits.join(truth.select(key).distinct(), key)
    total = truth.agg(F.greatest(F.countDistinct(key), F.lit(1)).alias("n"))
    return true.agg(*(F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks), F.min("rank").alias("first")).crossJoin(total).select(
        *(F.round(F.col(f"hit_{k}") / F.col("n"), 6).alias(f"recall_{k}") for k in ks), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def recall_mrr_all(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row over all questions that have a true key: mean recall at each k and mean reciprocal rank of the first true hit.

    ``hits``: question, key, rank; ``truth``: question, key, each pair counted once. Questions without hits count with 0.
    """
    pairs = truth.select("question", "key").distinct()
    return _means(hits.join(pairs, ["question", "key"]), pairs.groupBy("question").agg(F.count("*").alias("n")), ks)


def _means(true: DataFrame, each: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The metrics of the true hits ``question, rank``; ``each``: question and ``n``, its number of true keys."""
    found = true.groupBy("question").agg(*(F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks), F.min("rank").alias("first"))
    return each.join(found, "question", "left").agg(
        F.count("*").alias("questions"), *(F.round(F.avg(F.coalesce(F.col(f"hit_{k}") / F.col("n"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def recall_mrr_labels(hits: DataFrame, items: DataFrame, asked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``recall_mrr_all`` where the true keys of a question are all others of its label: ``items``: key, label; ``asked``: question, label.

    These pairs are as many as items times questions, so they are counted by label and only hits are looked up. Null
    labels are equal to none. A key or question with several labels counts once for each.
    """
    items, asked = items.filter("key is not null and label is not null").distinct(), asked.filter("question is not null and label is not null").distinct()
    own = asked.join(items.select(F.col("key").alias("question"), "label", F.lit(1).alias("_own")), ["question", "label"], "left")
    n = own.join(items.groupBy("label").agg(F.count("*").alias("_all")), "label").groupBy("question").agg(F.sum(F.col("_all") - F.coalesce("_own", F.lit(0))).alias("n"))
    true = hits.filter("key <> question").join(items, "key").join(asked, ["question", "label"], "left_semi")
    return _means(true, n.filter("n > 0"), ks)


def citations(text: Column, shape: str = CITED, group: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(group)))


def uncited(answers: DataFrame, key: str, known: DataFrame, known_id: str, text: str = "text", shape: str = CITED, group: int = 1) -> DataFrame:
    """``key, cited``: what answers cite, by the ``group`` of ``shape``, and no row of ``known`` is. A null text cites nothing."""
    rows = answers.select(key, F.explode(citations(F.col(text), shape, group)).alias("cited"))
    return rows.join(known.select(F.col(known_id).alias("cited")).distinct(), "cited", "left_anti").select(key, "cited")


#: Phrases that try to give orders to whoever reads a log.
INJECTION = [r"ignore (all |any )?(previous|prior|above) instructions", r"disregard (the |your )?(system|previous)", r"you are now", r"system prompt", r"</?(system|assistant|user)>"]


def injection(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(INJECTION)), F.lit(False))


def timeline(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Events and failures by hour or day, as the ts text's beginning."""
    at = F.substring("ts", 1, {"hour": 13, "day": 10, "minute": 16}[unit])
    return events.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failure").alias("failures")).orderBy("bucket")


def time_range_of(question: str, now: datetime) -> tuple[str, str] | None:
    """The span that a question asks for ("last 24h", "past 3 days", "yesterday", "today", "on 2026-08-14"), in UTC."""
    text, iso = question.lower(), lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    if m := re.search(r"(?:last|past) (\d+) ?(m|min|minutes?|h|hours?|d|days?|w|weeks?)\b", text):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2][0]]
        return iso(now - timedelta(**{unit: int(m[1])})), iso(now)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if "yesterday" in text:
        day -= timedelta(days=1)
    elif m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", text):
        try:
            day = day.replace(year=int(m[1]), month=int(m[2]), day=int(m[3]))
        except ValueError:
            return None
    elif "today" not in text:
        return None
    return iso(day), iso(day + timedelta(days=1) - timedelta(seconds=1))


def route(question: str) -> str:
    """``exact`` for questions of counts and lists, ``retrieve`` for all others."""
    return "exact" if re.search(r"\b(how many|count|number of|top \d*|most|list all|per (day|hour)|timeline|average|total)\b", question.lower()) else "retrieve"


def bursts(events: DataFrame, minutes: int, least: int) -> DataFrame:
    """Actors with at least ``least`` events within the ``minutes`` up to one of their events."""
    return running(events, ["principal"], minutes).groupBy("principal").agg(F.max("_n").alias("burst")).filter(F.col("burst") >= least)


def failure_then_success(events: DataFrame, success: str, minutes: int) -> DataFrame:
    """Events of an action that follow a failure of the same actor within ``minutes``."""
    seconds = F.unix_timestamp(F.to_timestamp("ts"))
    w = Window.partitionBy("principal").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("status") == "failure", seconds)).over(w)
    return events.withColumn("_last", last).filter((F.col("action") == success) & (seconds - F.col("_last") <= minutes * 60)).select("event_id", "principal", "ts")


def seconds() -> Column:
    return F.unix_timestamp(F.to_timestamp("ts"))


def steps_within(events: DataFrame, keys: list[str], actions: list[str], minutes: int) -> DataFrame:
    """Keys that did all ``actions``, in any order, within ``minutes``: ``keys, ts`` of the event that completed them first.

    Only the last time of each action is carried along, whatever a key's length.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.filter(F.col("action").isin(actions)).withColumn("_at", seconds())
    last = [F.max(F.when(F.col("action") == a, F.col("_at"))).over(w) for a in actions]
    rows = rows.withColumn("_oldest", last[0] if len(last) == 1 else F.least(*last)).withColumn("_all", sum((x.isNotNull().cast("int") for x in last), F.lit(0)))
    return rows.filter((F.col("_all") == len(actions)) & (F.col("_at") - F.col("_oldest") <= minutes * 60)).groupBy(*keys).agg(F.min("ts").alias("ts"))


def steps_in_order(events: DataFrame, keys: list[str], actions: list[str], minutes: int, resets: list[str] = []) -> DataFrame:
    """Events that end a row of ``actions``, done in that order by the same ``keys`` within ``minutes``.

    Order is that of ``ts, event_id``; other actions may stand between, but one of ``resets`` makes the row begin anew.
    Returns ``keys, event_id, ts`` and ``began``, the seconds of the latest first step that the event can end. Each step
    carries the latest beginning of the steps before it along. A key is split by time: a stretch takes the last
    ``minutes`` of the one before with it, which is all that its ends can reach back to, so no key is one task however
    many events it has. Without actions, or where times are null, nothing is found.
    """
    reach, at = minutes * 60, F.col("_at")
    size = max(reach, 86400)
    own = F.floor(at / size)
    rows = events.filter(F.col("action").isin([*actions, *resets])).select(*keys, "event_id", "ts", "action", seconds().alias("_at")).filter(at.isNotNull())
    rows = rows.withColumn("_own", own).withColumn("_part", F.explode(F.when(at >= (own + 1) * size - reach, F.array(own, own + 1)).otherwise(F.array(own))))
    inside = Window.partitionBy(*keys, "_part").orderBy("ts", "event_id")
    rows = rows.withColumn("_run", F.sum(F.col("action").isin(resets).cast("long")).over(inside))
    before = Window.partitionBy(*keys, "_part", "_run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    for i, action in enumerate(actions):
        rows = rows.withColumn(f"_s{i}", F.when(F.col("action") == action, F.max(f"_s{i - 1}").over(before) if i else at))
    began = F.col(f"_s{len(actions) - 1}") if actions else F.lit(None).cast("long")
    return rows.withColumn("began", began).filter((F.col("_own") == F.col("_part")) & (at - F.col("began") <= reach)).select(*keys, "event_id", "ts", "began")


def running(events: DataFrame, keys: list[str], minutes: int, column: str | None = None) -> DataFrame:
    """``keys, _at, ts, _n``: for each second of a key that has events, the events, or the different values of ``column``, of
    the ``minutes`` up to it and in it, and its least ``ts``.

    Rows of a second become one first. Each adds to the count at its second and takes that back when its minutes are over, or
    when its value comes again; the sum of these steps is the count, so the work grows with the events however many lie in
    those minutes. A key is cut by time as in ``steps_in_order``. Null times are a second of their own.
    """
    reach, at, own = minutes * 60, F.col("_at"), F.col("_own")
    size = max(reach, 86400)
    value = [column] if column else []
    rows = events.select(*keys, *value, "ts", seconds().alias("_at")).groupBy(*keys, *value, "_at").agg(F.count(F.col(column) if column else F.lit(1)).alias("_c"), F.min("ts").alias("ts"))
    rows = rows.withColumn("_own", F.floor(at / size)).withColumn("_part", F.explode(F.when(at >= (own + 1) * size - reach, F.array(own, own + 1)).otherwise(F.array(own))))
    here = own.eqNullSafe(F.col("_part"))
    until, count = at + reach + 1, F.col("_c")
    if column:
        again = F.lead("_at").over(Window.partitionBy(*keys, column, "_part").orderBy("_at"))
        rows, until, count = rows.withColumn("_again", again), F.least(until, F.col("_again")), (count > 0).cast("long")
    step = lambda when, n, ts, begins: F.struct(when.alias("_at"), n.alias("_step"), ts.alias("ts"), begins.alias("_here"))
    both = F.array(step(at, count, F.when(here, F.col("ts")), here), step(until, -count, F.lit(None).cast("string"), F.lit(False)))
    steps = rows.select(*keys, "_part", F.explode(F.when(at.isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("x")).select(*keys, "_part", "x.*")
    sums = steps.groupBy(*keys, "_part", "_at").agg(F.sum("_step").alias("_step"), F.min("ts").alias("ts"), F.bool_or("_here").alias("_here"))
    order = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("_n", F.sum("_step").over(order)).filter("_here").select(*keys, "_at", "ts", "_n")


def many_within(events: DataFrame, keys: list[str], minutes: int, least: int) -> DataFrame:
    """Keys with ``least`` events within ``minutes``: ``keys, ts`` of the event that reached it first. Events without a time don't count."""
    return running(events, keys, minutes).filter((F.col("_n") >= least) & F.col("_at").isNotNull()).groupBy(*keys).agg(F.min("ts").alias("ts"))


def different_within(events: DataFrame, keys: list[str], column: str, minutes: int, least: int) -> DataFrame:
    """Keys with ``least`` different values of ``column`` within ``minutes``: ``keys, ts`` as above."""
    return running(events, keys, minutes, column).filter((F.col("_n") >= least) & F.col("_at").isNotNull()).groupBy(*keys).agg(F.min("ts").alias("ts"))


def detections(events: DataFrame) -> DataFrame:
    """``type, principal, src_ip, ts`` of ten kinds of attacks; a part that a kind does not fix is blank."""
    act, failed, worked = F.col("action"), F.col("status") == "failure", F.col("status") == "success"
    both = ["principal", "src_ip"]

    def forced(login: Column, word: Column) -> DataFrame:
        """Twenty failures within an hour, and a success of the same actor and address after them."""
        tries = many_within(events.filter(login & failed), both, 60, 20).withColumnRenamed("ts", "since")
        return events.filter(word & worked).join(tries, both).filter("ts >= since").groupBy(*both).agg(F.min("ts").alias("ts"))
    console = act == "ConsoleLogin"
    found = {
        "console_brute_force": forced(console, console),
        "ssh_brute_force": forced(act == "sshd.failed_password", act == "sshd.accepted_password"),
        "iam_privilege_escalation": steps_within(events, both, ["CreateUser", "AttachUserPolicy", "CreateAccessKey"], 60),
        "s3_bucket_public": steps_within(events, both, ["PutBucketPolicy", "PutBucketAcl"], 60),
        "security_group_open_to_world": many_within(events.filter(act == "AuthorizeSecurityGroupIngress"), both, 60, 3),
        "logging_tampering": steps_within(events, both, ["StopLogging", "DeleteTrail"], 60),
        "root_account_usage": events.filter(console & worked & is_root(F.col("principal"))).groupBy(*both).agg(F.min("ts").alias("ts")),
        "credential_stuffing": different_within(events.filter((act == "AssumeRole") & failed), ["src_ip"], "principal", 15, 8),
        "impossible_travel": different_within(events.filter(console & worked & (F.col("src_ip") != "")), ["principal"], "src_ip", 15, 3),
        "s3_data_exfiltration": many_within(events.filter(act == "GetObject"), both, 30, 500)}
    out = None
    for kind, rows in found.items():
        one = rows.select(F.lit(kind).alias("type"), *(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in both), "ts")
        out = one if out is None else out.unionByName(one)
    return out
