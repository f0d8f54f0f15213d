"""Jobs: files to event, window and bridge tables; windows to an index; a question to ranked windows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import fields
from ..operators import days, incremental, inverted_index, retrieval, tables, windows
from ..schemas import EVENT, STORED_WINDOW, WINDOW
from ..sources.logs import load_events, resolve_year

SCHEMA_VERSION = 3

#: What a vector's window must still agree on: ids are places in time, which an ingest of more events moves.
SAME = ["chunk_id", "source", "principal", "src_ip", "ts_start", "ts_end", "n_events"]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none yet."""
    return spark.read.parquet(path) if shared.exists(spark, path) else None


def stored_events(spark: SparkSession, out: str) -> DataFrame:
    """The events of a store, each with its ``day``."""
    return days.read(spark, f"{out}/events", EVENT)


def stored_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows of a store, kept by day or not."""
    return days.read(spark, f"{out}/windows", STORED_WINDOW).select(*WINDOW.names)


def stored_vectors(spark: SparkSession, out: str) -> DataFrame | None:
    """The vectors of a store, each with its ``day`` where they are kept so; or None."""
    rows = stored(spark, f"{out}/vectors")
    return rows if rows is None or days.DAY not in rows.columns else days.read(spark, f"{out}/vectors", rows.schema)


def put_bridge(spark: SparkSession, out: str, only: list[str] | None = None) -> None:
    """``window_events`` of windows kept by day, in the folders of their windows; all of them, or those of some days."""
    kept = days.read(spark, f"{out}/windows", STORED_WINDOW).select("chunk_id", "ts_start", "event_ids", days.DAY)
    kept = kept if only is None else kept.filter(F.col(days.DAY).isin(only))
    rows = kept.select("chunk_id", F.posexplode("event_ids").alias("position", "event_id"), "ts_start", days.DAY).select("chunk_id", "event_id", "position", "ts_start", days.DAY)
    days.write(rows, f"{out}/window_events", changed_only=only is not None)
    if only:
        have = {r[0] for r in kept.select(days.DAY).distinct().collect()}
        for day in sorted(set(only) - have):
            shared.drop(spark, f"{out}/window_events/{days.DAY}={day}")


def update_windows(spark: SparkSession, out: str, gap_minutes: int, max_chars: int, max_events: int) -> dict[str, int]:
    """Bring the windows, kept by day, up to the events; ``_touched`` has the changes since, and goes at the end.

    A run that dies leaves ``_touched``, and the next one does its work over. The days of windows and events to read and
    to rewrite pass through the driver: one row each.
    """
    path, touched = f"{out}/windows", f"{out}/_touched"
    days.recover(spark, path, STORED_WINDOW)
    changed, kept = spark.read.schema("event_id string, source string, principal string, src_ip string, ts string").parquet(touched), days.read(spark, path, STORED_WINDOW)
    gone = shared.cut(incremental.reached(kept, changed, gap_minutes))
    own = kept.filter(F.col(days.DAY).isin([r[0] for r in gone.select(days.DAY).distinct().collect()])).join(gone.select("chunk_id"), "chunk_id", "left_semi")
    ids = own.select(F.explode("event_ids").alias("event_id")).union(changed.select("event_id")).distinct()
    span, events = [r[0] for r in incremental.days_of(own, changed).collect()], stored_events(spark, out)
    events = tables.by_ids(events if None in span else events.filter(F.col(days.DAY).isin(span)), "event_id", ids).drop(days.DAY)
    built = incremental.continued(windows.build_windows(events, gap_minutes, max_chars, max_events, by_content=True), gone)
    built = shared.cut(days.with_day(built.select(*STORED_WINDOW.names)))
    # What came out as it was stays where it is.
    same = ["chunk_id", "session_start"]
    fresh, old = built.join(gone.select(*same), same, "left_anti"), gone.join(built.select(*same), same, "left_anti").select("chunk_id", days.DAY)
    report = {"windows_rebuilt": built.count(), "windows_changed": fresh.count()}
    late = fresh.select(days.DAY).union(old.select(days.DAY)).distinct()
    late.coalesce(1).write.mode("append").json(f"{out}/_bridge_days")
    replaced = days.replace(spark, path, old, fresh, "chunk_id")
    put_bridge(spark, out, sorted({r[0] for r in spark.read.schema("day string").json(f"{out}/_bridge_days").collect()}))
    for name in ("_bridge_days", "_touched"):
        shared.drop(spark, f"{out}/{name}")
    return report | {"window_days": replaced["days"], "window_days_rewritten": replaced["days_rewritten"]}


def advance(spark: SparkSession, out: str, new: DataFrame, gap_minutes: int, max_chars: int, max_events: int) -> dict[str, int]:
    """Merge events, one row an id, into a store whose windows have stable ids, and bring these up to them. ``new`` is read several times."""
    incremental.changes(new, stored_events(spark, out)).write.mode("append").parquet(f"{out}/_touched")
    return days.merge(spark, f"{out}/events", new, "event_id") | update_windows(spark, out, gap_minutes, max_chars, max_events)


def build_all(spark: SparkSession, out: str, gap_minutes: int, max_chars: int, max_events: int, by_content: bool) -> None:
    """Windows and their events from all events: numbered, or kept by day with ids that a later update leaves."""
    for name in ("windows_changed", "windows_changed_days", "_bridge_days", "_touched"):
        shared.drop(spark, f"{out}/{name}")
    built = windows.build_windows(stored_events(spark, out).drop(days.DAY), gap_minutes, max_chars, max_events, by_content=by_content)
    if by_content:
        days.write(days.with_day(built.select(*STORED_WINDOW.names)), f"{out}/windows")
        put_bridge(spark, out)
    else:
        built.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/windows")
        windows.membership(spark.read.parquet(f"{out}/windows")).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/window_events")


def ingest(spark: SparkSession, raw: str | list[str], out: str, year: int | None = None, gap_minutes: int = 15, limit: int | None = None, rebuild: bool = False,
           max_chars: int = 4800, max_events: int = 120, stable_ids: bool = False) -> dict:
    """Parse, keep one row per event_id, window, and write ``events``, ``windows`` and ``window_events`` as Parquet.

    Events stored before stay unless ``rebuild``; of equal ids the new one wins. Events are kept by day, and only the days
    that new ones change are rewritten. All windows are built anew and numbered, so none is stale; with ``stable_ids`` their
    ids follow from their events, and where the store has such windows of the same rules only sessions that new events reach
    are built anew. ``limit`` takes the first events by file and place. Without a ``year`` a manifest's is taken, or this one.
    A path that isn't there is an error, and what is stored stays as it is.
    """
    began, paths = time.time(), [raw] if isinstance(raw, str) else list(raw)
    for path in paths:
        if not shared.exists(spark, path):
            raise FileNotFoundError(path)
    year = year or resolve_year(spark, paths)
    events, counters = load_events(spark, paths, year)
    if limit is not None:
        events = events.orderBy("file", "place").limit(limit)
    if rebuild:
        for name in ("events", "events_changed", "events_changed_days"):
            shared.drop(spark, f"{out}/{name}")
    elif (version := get_meta(spark, out).get("schema_version")) not in (None, str(SCHEMA_VERSION)):
        raise ValueError(f"the store has schema version {version}, not {SCHEMA_VERSION}: ingest with rebuild")
    rules = f"{gap_minutes},{max_chars},{max_events}" if stable_ids else ""
    onward = bool(rules) and not rebuild and get_meta(spark, out).get("window_rules") == rules and shared.exists(spark, f"{out}/windows")
    if not onward and get_meta(spark, out).get("window_rules"):
        # Until all windows are built, none of the store's can be brought up to its events.
        set_meta(spark, out, window_rules="")
    days.recover(spark, f"{out}/events", EVENT)
    fresh = f"{out}/_fresh"
    tables.upsert(events.withColumn("_seq", F.struct("file", "place")).drop("file", "place"), "event_id", "_seq").write.mode("overwrite").parquet(fresh)
    new = spark.read.parquet(fresh).select(*EVENT.names)
    if onward:
        changed = advance(spark, out, new, gap_minutes, max_chars, max_events)
    else:
        changed = days.merge(spark, f"{out}/events", new, "event_id")
        build_all(spark, out, gap_minutes, max_chars, max_events, stable_ids)
    shared.drop(spark, fresh)
    now = stored_events(spark, out)
    built = stored_windows(spark, out)
    report = counters.get() | changed | {"by_source": {r["source"]: r["n"] for r in tables.count_by(now, "source").collect()}, "assumed_year": year}
    report |= {"events": sum(report["by_source"].values())} | windows.summarize(built).first().asDict()
    report["windows_by_source"] = {r["source"]: r["windows"] for r in windows.by_source(built).collect()}
    set_meta(spark, out, schema_version=SCHEMA_VERSION, last_ingest=fields.utc_now(), assumed_year=year, window_rules=rules)
    return report | {"seconds": round(time.time() - began, 2)}


def drop_tables(spark: SparkSession, out: str) -> None:
    """All tables of a store, and its index."""
    for name in ("events", "windows", "window_events", "vectors", "lexical", "index_meta", "meta", "events_changed", "events_changed_days", "windows_changed", "windows_changed_days", "vectors_changed", "vectors_changed_days", "_vectors", "_touched", "_bridge_days", "_fresh"):
        shared.drop(spark, f"{out}/{name}")


def get_meta(spark: SparkSession, out: str) -> dict[str, str]:
    """The store's facts by name: a few rows."""
    rows = stored(spark, f"{out}/meta")
    return {} if rows is None else {r["key"]: r["value"] for r in rows.collect()}


def set_meta(spark: SparkSession, out: str, **facts) -> None:
    now = get_meta(spark, out) | {k: str(v) for k, v in facts.items()}
    spark.createDataFrame(sorted(now.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{out}/meta")


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Windows as lines of JSON; how many. They are counted while they are written."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Windows from lines of JSON; unknown fields fall away, missing ones are null, broken lines are left out."""
    rows = spark.read.schema(T.StructType([*WINDOW.fields, T.StructField("_broken", T.StringType())])).option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null and chunk_id is not null").drop("_broken")


def as_records(rows: DataFrame) -> DataFrame:
    """Rows as ``record``, one JSON object each."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))


def from_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse; fields that the schema lacks fall away."""
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def searched(built: DataFrame) -> DataFrame:
    """Windows with the text that BM25 sees as ``text``."""
    return built.withColumn("text", F.coalesce(F.nullif("search_text", F.lit("")), "text"))


def index(spark: SparkSession, out: str, embed: Callable[[DataFrame], DataFrame], reset: bool = False, limit: int | None = None, max_tokens: int | None = retrieval.MAX_TOKENS) -> dict:
    """Embed the windows that the index lacks and append them; returns what was done. ``embed`` adds ``embedding``.

    Where windows have stable ids, vectors are kept by day as well, and those of windows that are gone or changed are taken
    out; only the days of these and of new ones are rewritten. The inverted index for BM25 is written beside the vectors, and the facts of the build in ``index_meta``. ``limit`` takes
    the first windows by id.
    """
    began, built, path = time.time(), stored_windows(spark, out), f"{out}/vectors"
    rows = built.select("chunk_id", "source", "principal", "src_ip", "ts_start", "ts_end", "n_events", "n_failures", "risk_score", "text")
    rows = rows if limit is None else rows.orderBy("chunk_id").limit(limit)
    by_day = bool(get_meta(spark, out).get("window_rules"))
    if shared.exists(spark, f"{path}_changed/_SUCCESS"):
        days.recover(spark, path, spark.read.parquet(f"{path}_changed").schema)
    done = None if reset else stored_vectors(spark, out)
    done = done if done is None or by_day == (days.DAY in done.columns) else None
    seen = Observation()
    todo = embed(rows if done is None else tables.missing(rows, done, "chunk_id")).drop("text").observe(seen, F.count("*").alias("n"))
    if not by_day:
        todo.write.mode("overwrite" if done is None else "append").option("partitionOverwriteMode", "static").parquet(path)
    elif done is None:
        days.write(days.with_day(todo), path)
    else:
        todo.write.mode("overwrite").parquet(f"{out}/_vectors")
        gone = done.join(built.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", days.DAY)
        days.replace(spark, path, gone, days.with_day(spark.read.parquet(f"{out}/_vectors")), "chunk_id")
        shared.drop(spark, f"{out}/_vectors")
    n = seen.get["n"]
    inverted_index.write(searched(built), "chunk_id", f"{out}/lexical", max_tokens=max_tokens or None)
    total = stored_vectors(spark, out).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"))
    total.withColumn("built_at", F.lit(fields.utc_now())).coalesce(1).write.mode("overwrite").json(f"{out}/index_meta")
    asked = rows.count()
    took = time.time() - began
    return {"windows": asked, "embedded": n, "skipped_existing": asked - n, "seconds": round(took, 2), "rate": round(n / max(took, 1e-9), 1)} | index_meta(spark, out)


def index_meta(spark: SparkSession, out: str) -> dict:
    """Facts of the last build; empty if there are none."""
    if not shared.exists(spark, f"{out}/index_meta"):
        return {}
    row = spark.read.schema("vectors long, dim int, built_at string").json(f"{out}/index_meta").first()
    return row.asDict() if row and row["vectors"] is not None else {}


def index_health(spark: SparkSession, out: str) -> dict:
    """What the build says against what is stored: missing windows, vectors of windows that are gone, repeated ones."""
    built, vectors = stored_windows(spark, out), stored_vectors(spark, out)
    meta = index_meta(spark, out)
    if vectors is None:
        return {"windows": built.count(), "vectors": 0, "missing": built.count(), "stale": 0, "repeated": 0, "dim": None, "healthy": False}
    seen = vectors.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.max(F.size("embedding")).alias("dim")).first()
    facts = {"windows": built.count(), "vectors": seen["n"], "missing": tables.missing(built, vectors, "chunk_id").count(),
             "stale": vectors.join(built.select(*SAME), SAME, "left_anti").count(), "repeated": seen["n"] - seen["ids"], "dim": seen["dim"]}
    good = meta.get("vectors") == seen["n"] and meta.get("dim") == seen["dim"] and not (facts["missing"] or facts["stale"] or facts["repeated"])
    return facts | {"healthy": good}


def hashed_embedding(rows: DataFrame, dim: int = 64) -> DataFrame:
    """Deterministic stand-in for a model: hashed term counts of ``text``, of length 1; ``dim`` is at most 90.

    A text becomes one string with a character a term; a place's count is how much shorter the string is without its
    character. Counts and norm are bound once a row.
    """
    if dim > 90:
        raise ValueError("a place is one of 90 printable characters")
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    places = F.array_join(F.transform(fields.tokenize(F.col("text")), lambda t: F.char(F.pmod(F.xxhash64(t), F.lit(dim)) + 33)), "")
    counts = lambda s: F.array(*((F.length(s) - F.length(F.replace(s, F.lit(chr(33 + i)), F.lit("")))).cast("double") for i in range(dim)))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return rows.withColumn("embedding", let(places, lambda s: let(counts(s), lambda c: let(norm(c), lambda n: F.transform(c, lambda x: (x / n).cast("float"))))))


def retrieve(docs: DataFrame, vectors: DataFrame, key: str, question: str, vector: list[float], k: int = 5, pool: int = 50, where=None, scorer=None, counts: DataFrame | None = None,
             max_tokens: int | None = None, rrf_k: int = 60, top_n: int = 50, lexical: str | None = None, report: dict | None = None) -> DataFrame:
    """Dense and BM25 candidates, fused, joined to their rows and reranked; the k best.

    A blank question asks no retriever and has no hits. ``lexical`` is the path of a stored inverted index. Candidates that
    ``docs`` lacks fall away; with ``report`` they are counted there, as are the candidates of each stage and its time. The
    candidates, ``2 * pool`` rows at most, then pass through the driver.
    """
    spark, began = docs.sparkSession, time.time()
    seen = report if report is not None else {}
    seen.update({"k": k or 5, "dense_candidates": 0, "bm25_candidates": 0, "fused_candidates": 0, "missing_from_store": 0, "rerank_applied": scorer is not None})

    def kept(name: str, rows: DataFrame) -> DataFrame:
        if report is None:
            return rows
        at, few = time.time(), rows.collect()
        seen[f"{name}_candidates"] = len(few)
        seen.setdefault("timings_ms", {})[f"{name}_ms"] = round(1000 * (time.time() - at), 1)
        return spark.createDataFrame(few, rows.schema)
    if not question.strip():
        return spark.createDataFrame([], docs.select(key).schema).selectExpr(key, "0d as score", "'' as sources", "0 as rank", "0 as dense_rank", "0 as bm25_rank", "'' as text", "0d as rerank_score")
    bm25 = inverted_index.search(spark, lexical, question, pool, key=key) if lexical else retrieval.bm25(docs, key, question, pool, counts=counts, max_tokens=max_tokens)
    both = {"dense": kept("dense", retrieval.dense(vectors, key, vector, pool, where=where)), "bm25": kept("bm25", bm25)}
    named = kept("fused", retrieval.fuse(both, key, rrf_k, limit=pool, ranks=True))
    # The candidates are few, the texts stay where they are read.
    found = docs.select(key, "text").join(F.broadcast(named), key).select(*named.columns, "text")
    if report is not None:
        seen["missing_from_store"] = named.join(docs.select(key), key, "left_anti").count()
    hits = retrieval.rerank(found, key, scorer, top_n).filter(F.col("rank") <= (k or 5)).orderBy("rank")
    if report is not None:
        seen["timings_ms"]["total_ms"] = round(1000 * (time.time() - began), 1)
    return hits
