"""Commands: ingest, stats, index, search, version. Exit code 2 where inputs are missing."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions.fields import render_line
from .operators import tables, windows
from .plans import ingest as plans
from .plans import models, render
from .settings import from_env, setup_logging

VERSION = "0.1.0"


def say(value, as_json: bool) -> None:
    print(json.dumps(value, default=str) if as_json else "\n".join(f"{k}: {v}" for k, v in value.items()))


def stats(spark: SparkSession, out: str, top: int) -> dict:
    """Counts, ranges, top lists and window sizes; only these aggregates come to the driver."""
    events, built = plans.stored_events(spark, out), plans.stored_windows(spark, out)
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "totals": {"events": events.count(), "windows": built.count(), "window_events": spark.read.parquet(f"{out}/window_events").count()},
        "schema_version": plans.get_meta(spark, out).get("schema_version", ""), "windows_by_source": rows(windows.by_source(built)),
        "time_range": rows(tables.time_range(events))[0], "by_source": rows(tables.count_by(events, "source")), "by_status": rows(tables.count_by(events, "status")),
        "top_actions": rows(tables.top(events, "action", top)), "top_principals": rows(tables.top(events, "principal", top)), "top_src_ips": rows(tables.top(events, "src_ip", top)),
        "failure_pct": tables.failure_pct(events).first()[0], "windows": rows(windows.summarize(built))[0], "sizes": rows(windows.sizes(built))[0]}


def search(spark: SparkSession, out: str, question: str, k: int, show_events: int = 0, rerank: bool = True, report: dict | None = None) -> list[dict]:
    """The k best windows with their event ids, with ``show_events`` also the lines of that many of their events; ``report``
    takes the counts and times of the stages."""
    built, settings = plans.stored_windows(spark, out), from_env()
    asked = models.embedder(settings)(spark.range(1).select(F.lit(question).alias("text"))).first()["embedding"]
    lexical = f"{out}/lexical" if shared.exists(spark, f"{out}/lexical") else None
    hits = plans.retrieve(plans.searched(built), plans.stored_vectors(spark, out), "chunk_id", question, list(asked), k=k or settings.top_k, pool=settings.pool,
                          scorer=models.reranker(question, settings, enabled=rerank and settings.rerank_enabled), rrf_k=settings.rrf_k, top_n=settings.rerank_top_n,
                          lexical=lexical, max_tokens=settings.max_tokens, report=report).drop("text").join(built, "chunk_id")
    if show_events:
        events = plans.stored_events(spark, out)
        shown = hits.select("chunk_id", F.posexplode(F.slice("event_ids", 1, show_events)).alias("i", "event_id"))
        lines = shown.join(events.select("event_id", render_line({c: F.col(c) for c in events.columns}).alias("line")), "event_id").groupBy("chunk_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("events"))
        hits = hits.join(lines, "chunk_id", "left")
    return [r.asDict() for r in hits.orderBy("rank").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="logloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "stats", "index", "search", "version"):
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        if name == "ingest":
            c.add_argument("--raw", required=True, action="append", help="a folder or a file; may be given again")
            c.add_argument("--year", type=int, help="of syslog lines; without it a manifest's, or this one")
            c.add_argument("--jsonl", help="also write the windows as lines of JSON")
            c.add_argument("--limit", type=int)
            c.add_argument("--rebuild", action="store_true", help="drop the events stored before")
            c.add_argument("--stable-ids", action="store_true", help="ids of windows follow from their events; only sessions that new events reach are built anew")
        if name == "stats":
            c.add_argument("--top", type=int, default=5)
        if name == "index":
            c.add_argument("--reset", action="store_true", help="embed all windows anew")
            c.add_argument("--no-resume", action="store_true", help="the same: what is stored already is not taken over")
            c.add_argument("--limit", type=int)
            c.add_argument("--check", action="store_true", help="only compare the index with the windows; exit code 1 if they differ")
        if name == "search":
            c.add_argument("query")
            c.add_argument("-k", type=int, default=5)
            c.add_argument("--no-rerank", action="store_true")
            c.add_argument("--show-events", type=int, default=0, metavar="N")
        if name != "version":
            c.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    for need in {"ingest": getattr(a, "raw", []), "stats": [f"{a.out}/events"], "index": [f"{a.out}/windows"], "search": [f"{a.out}/vectors"]}[a.command]:
        if "://" not in need and not Path(need).exists():
            print(f"missing: {need}", file=sys.stderr)
            return 2
    setup_logging("WARNING")
    settings = from_env()
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ingest":
        report = plans.ingest(spark, a.raw, a.out, a.year, settings.gap_minutes, limit=a.limit, rebuild=a.rebuild, max_chars=settings.max_chars, max_events=settings.max_events, stable_ids=a.stable_ids)
        if a.jsonl:
            report["jsonl"] = plans.write_jsonl(plans.stored_windows(spark, a.out), a.jsonl)
        say(report, a.json)
    elif a.command == "stats":
        report = stats(spark, a.out, a.top)
        lists = {} if a.json else {name: report.pop(f"top_{name}s") for name in ("action", "principal", "src_ip")}
        say(report, a.json)
        for name, rows in lists.items():
            print("\n".join(render.ranked_lines(f"top {name}s", rows, name)))
    elif a.command == "index" and a.check:
        health = plans.index_health(spark, a.out)
        say(health, a.json)
        return 0 if health["healthy"] else 1
    elif a.command == "index":
        anew = a.reset or a.no_resume or not settings.index_resume
        say(plans.index(spark, a.out, models.embedder(settings), anew, a.limit, settings.max_tokens), a.json)
    else:
        facts: dict = {}
        hits = search(spark, a.out, a.query, a.k, a.show_events, not a.no_rerank, facts)
        if a.json:
            print(json.dumps(render.answer(a.query, hits, facts | {"windows": len(hits), "events": [h.get("events") for h in hits] if a.show_events else None}), default=str))
        else:
            print("\n".join(line for hit in hits for line in render.hit_lines(hit, a.show_events)) or "no windows matched")
    return 0


if __name__ == "__main__":
    sys.exit(main())
