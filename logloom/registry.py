"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

``events`` become log events: source, address, account, region and resource follow from the user's and the event's
number, the event type gives status and action; one event in nine takes the name of a sensitive action instead, and one
user in fifty is a root account.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import fields
from .operators import days, evaluate, inverted_index, retrieval, tables, vector_index, windows
from .plans import ingest
from .plans.ingest import retrieve
from .sources.logs import detect_source, is_log_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
QUESTION = "the License version 2.0 idiot thntion-over"
SOURCES = ["cloudtrail", "auth", "syslog"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files give fewer tasks than there are cores (small files), its rows are dealt over the cores."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n, user = F.col("event_id"), F.col("user_id")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    text = lambda lead, c: F.concat(F.lit(lead), c.cast("string"))
    none = F.lit("")
    return e.select(
        text("ev-", n).alias("event_id"), fields.iso_utc(F.col("ts").cast("timestamp")).alias("ts"), pick(SOURCES, user % 3).alias("source"),
        F.when(n % 9 == 0, pick(sorted(fields.RISK_WEIGHTS), F.floor(n / 9) % len(fields.RISK_WEIGHTS))).otherwise(F.col("event_type")).alias("action"),
        fields.normalize_status(F.col("event_type")).alias("status"),
        F.when(user % 50 == 7, F.concat(text("arn:aws:iam::", user), F.lit(":root"))).otherwise(text("user-", user)).alias("principal"),
        F.when(user % 4 == 0, none).otherwise(F.concat(text("10.", user % 4), text(".0.", user % 250))).alias("src_ip"),
        F.when(n % 3 == 0, none).otherwise(text("r", n % 3)).alias("region"), F.when(user % 5 == 0, none).otherwise(text("acct-", user % 5)).alias("account_id"),
        F.when(n % 7 == 0, text("bucket=b", n % 13)).otherwise(none).alias("resource"), none.alias("user_agent"), none.alias("raw"), none.alias("raw_ref"), F.col("props").alias("extra"))


def app_windows(spark: SparkSession, sf_dir: str, gap: int = 720, most: int = 10, chars: int = 4800) -> DataFrame:
    return windows.build_windows(app_events(spark, sf_dir), gap, max_chars=chars, max_events=most)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_windows(spark, sf_dir).select("chunk_id", "ts_start", "ts_end", "principal", "n_events", "n_failures", "risk_score")


#: Written from the data model, not from the operators: the same actions and weights as text.
EV = """sensitive(action, weight) AS (VALUES ('AddUserToGroup', 25), ('AssumeRole', 10), ('AttachRolePolicy', 35), ('AttachUserPolicy', 35), ('AuthorizeSecurityGroupEgress', 25),
  ('AuthorizeSecurityGroupIngress', 30), ('CreateAccessKey', 30), ('CreateFunction', 20), ('CreateLoginProfile', 30), ('CreatePolicyVersion', 30), ('CreateUser', 20), ('DeleteBucketPolicy', 20),
  ('DeleteDBInstance', 30), ('DeleteTrail', 40), ('DeleteUser', 25), ('GetSecretValue', 25), ('ModifySecurityGroupRules', 25), ('PutBucketAcl', 25), ('PutBucketPolicy', 30),
  ('PutBucketPublicAccessBlock', 15), ('PutEventSelectors', 30), ('PutRolePolicy', 30), ('PutUserPolicy', 30), ('StopLogging', 40), ('UpdateFunctionCode', 25), ('UpdateLoginProfile', 25), ('UpdateTrail', 30)),
  named AS (SELECT action, row_number() OVER (ORDER BY action) - 1 AS i FROM sensitive),
  ev AS (SELECT 'ev-' || event_id AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CASE user_id % 3 WHEN 0 THEN 'cloudtrail' WHEN 1 THEN 'auth' ELSE 'syslog' END AS source,
  coalesce(named.action, event_type) AS action,
  CASE WHEN lower(event_type) IN ('success','succeeded','ok','accepted') THEN 'success'
       WHEN regexp_matches(lower(event_type), 'fail|denied|deny|error|invalid|unauthorized|refused|timeout|locked|no such|killed|segfault|panic|critical|unable to') THEN 'failure'
       ELSE 'info' END AS status, CASE WHEN user_id % 50 = 7 THEN 'arn:aws:iam::' || user_id || ':root' ELSE 'user-' || user_id END AS principal,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE '10.' || user_id % 4 || '.0.' || user_id % 250 END AS src_ip, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'r' || event_id % 3 END AS region,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE 'acct-' || user_id % 5 END AS account_id, CASE WHEN event_id % 7 = 0 THEN 'bucket=b' || event_id % 13 ELSE '' END AS resource
  FROM events LEFT JOIN named ON event_id % 9 = 0 AND named.i = (event_id // 9) % 27)"""
#: A line as answers cite it: time, action, mark, principal, address, region, id.
LINE = """concat_ws(' | ', ts, coalesce(nullif(action, ''), '-'), CASE status WHEN 'success' THEN 'OK' WHEN 'failure' THEN 'FAIL' ELSE 'INFO' END,
  coalesce(nullif(principal, ''), '-'), coalesce(nullif(src_ip, ''), '-'), coalesce(nullif(region, ''), '-'), event_id)"""
WIN = """, timed AS (SELECT *, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s, {line} AS line FROM ev),
  lagged AS (SELECT *, lag(s) OVER (PARTITION BY source, principal, src_ip ORDER BY ts, event_id) AS prev FROM timed),
  grp AS (SELECT *, sum(CASE WHEN s - prev > {gap} * 60 THEN 1 ELSE 0 END) OVER (PARTITION BY source, principal, src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM lagged),
  seq AS (SELECT *, row_number() OVER same AS rn, min(ts) OVER (PARTITION BY source, principal, src_ip, g) AS first FROM grp WINDOW same AS (PARTITION BY source, principal, src_ip, g ORDER BY ts, event_id)),
  walk AS (SELECT source, principal, src_ip, g, rn, event_id, length(line) + 3 AS chars, 1 AS n, 0 AS p FROM seq WHERE rn = 1
    UNION ALL SELECT s.source, s.principal, s.src_ip, s.g, s.rn, s.event_id, CASE WHEN w.chars + length(s.line) + 3 > {chars} OR w.n >= {most} THEN 0 ELSE w.chars END + length(s.line) + 3,
      CASE WHEN w.chars + length(s.line) + 3 > {chars} OR w.n >= {most} THEN 1 ELSE w.n + 1 END, w.p + CASE WHEN w.chars + length(s.line) + 3 > {chars} OR w.n >= {most} THEN 1 ELSE 0 END
    FROM walk w JOIN seq s ON s.source = w.source AND s.principal = w.principal AND s.src_ip = w.src_ip AND s.g = w.g AND s.rn = w.rn + 1),
  cut AS (SELECT seq.*, p FROM seq JOIN walk USING (source, principal, src_ip, g, rn)),
  num AS (SELECT source, principal, src_ip, g, p, row_number() OVER (ORDER BY first, source, principal, src_ip, g, p) AS n FROM (SELECT DISTINCT source, principal, src_ip, g, p, first FROM cut)),
  win AS (SELECT 'w-' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS chunk_id, cut.* FROM cut JOIN num USING (source, principal, src_ip, g, p)),
  known AS (SELECT chunk_id, sum(weight) AS weight FROM (SELECT DISTINCT chunk_id, action FROM win) JOIN sensitive USING (action) GROUP BY 1),
  agg AS (SELECT chunk_id, min(ts) AS ts_start, max(ts) AS ts_end, any_value(source) AS source, any_value(principal) AS principal, any_value(src_ip) AS src_ip, CAST(count(*) AS INTEGER) AS n_events,
    CAST(count(*) FILTER (status = 'failure') AS INTEGER) AS n_failures, CAST(least(100, coalesce(any_value(weight), 0) + least(30, 2 * count(*) FILTER (status = 'failure'))
    + CASE WHEN any_value(principal) LIKE '%:root%' THEN 25 ELSE 0 END) AS INTEGER) AS risk_score,
    string_agg(DISTINCT action, ',' ORDER BY action) AS event_names, coalesce(string_agg(DISTINCT account_id, ',' ORDER BY account_id) FILTER (account_id <> ''), '') AS accounts
    FROM win LEFT JOIN known USING (chunk_id) GROUP BY chunk_id)"""
W720, W15, WCHARS = (WIN.format(line=LINE, gap=g, most=m, chars=c) for g, m, c in ((720, 10, 4800), (15, 120, 4800), (1440, 120, 300)))
TOK = r"""tok AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9_.:\-/@+]*'), lambda r: list_concat([lower(r)],
    CASE WHEN regexp_full_match(r, '[0-9]{1,3}(\.[0-9]{1,3}){3}') OR NOT regexp_matches(r, '[A-Z]') THEN [] ELSE list_filter(list_transform(
      regexp_extract_all(regexp_replace(r, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2 AND p <> lower(r)) END,
    CASE WHEN regexp_full_match(r, '[0-9]{1,3}(\.[0-9]{1,3}){3}') OR NOT regexp_matches(r, '[._:\-/@+]') THEN [] ELSE list_filter(list_transform(
      regexp_split_to_array(r, '[._:\-/@+]+'), lambda p: lower(p)), lambda p: length(p) >= 2 AND p <> lower(r)) END))) AS t FROM documents)"""
POST = """, post AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
  raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM = """, q AS (SELECT * FROM (VALUES ('the', 1), ('license', 1), ('version', 1), ('2.0', 1), ('idiot', 1), ('thntion-over', 1), ('thntion', 1), ('over', 1)) q(term, times)),
  scored AS (SELECT doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(t)) FROM tok)))), 6) AS score
    FROM post JOIN q USING (term) JOIN idf USING (term) GROUP BY doc_id),
  bm AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 50)"""
DENSE = """den AS (SELECT vec_id AS doc_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
    (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings {where}) ORDER BY score DESC, vec_id LIMIT 50)"""
FUSE = """, fused AS (SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(DISTINCT r, ',' ORDER BY r) AS sources FROM (
    SELECT doc_id, rank, 'bm25' AS r, {b} AS w FROM bm UNION ALL SELECT doc_id, rank, 'dense', {d} FROM den) GROUP BY doc_id)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f
    return put


def on_events(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {EV} {sql}")(lambda spark, d: f(app_events(spark, d)))


def on_windows(name: str, sql: str, f: Callable[[DataFrame], DataFrame], ctes: str = W720, gap: int = 720, most: int = 10, chars: int = 4800) -> None:
    query(name, f"WITH RECURSIVE {EV}{ctes} {sql}")(lambda spark, d: f(app_windows(spark, d, gap, most, chars)))


on_events("events_by_source", "SELECT source, count(*) AS n FROM ev GROUP BY 1", lambda e: tables.count_by(e, "source"))
on_events("events_by_status", "SELECT status, count(*) AS n FROM ev GROUP BY 1", lambda e: tables.count_by(e, "status"))
on_events("events_by_action", "SELECT action, count(*) AS n FROM ev GROUP BY 1", lambda e: tables.count_by(e, "action"))
on_events("time_range", "SELECT coalesce(min(ts), '') AS ts_min, coalesce(max(ts), '') AS ts_max FROM ev", tables.time_range)
for _name, _col, _status in (("top_actions", "action", None), ("top_actions_failure", "action", "failure"), ("top_principals", "principal", None), ("top_src_ips", "src_ip", None)):
    _where = (["status = 'failure'"] if _status else []) + ([f"{_col} <> ''"] if _col != "action" else [])
    on_events(_name, f"SELECT {_col}, count(*) AS n, count(*) FILTER (status = 'failure') AS failures FROM ev {'WHERE ' + ' AND '.join(_where) if _where else ''} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
              lambda e, c=_col, s=_status: tables.top(e, c, 10, s))
on_events("events_between", "SELECT event_id, ts, action, principal FROM ev WHERE ts BETWEEN '2024-01-05' AND '2024-01-06' AND status = 'failure' ORDER BY ts, event_id LIMIT 500",
          lambda e: tables.between(e, "2024-01-05", "2024-01-06", status="failure").select("event_id", "ts", "action", "principal"))
on_events("get_event", "SELECT event_id, ts, action, principal, status FROM ev WHERE event_id = 'ev-7'", lambda e: tables.by_ids(e, "event_id", ["ev-7"]).select("event_id", "ts", "action", "principal", "status"))
on_events("failure_pct", "SELECT round(100.0 * count(*) FILTER (status = 'failure') / greatest(count(*), 1), 6) AS failure_pct FROM ev", tables.failure_pct)
on_events("normalize_status", "SELECT DISTINCT action, status FROM ev", lambda e: e.select("action", "status").distinct())
on_events("stable_ids", "SELECT event_id, 'sl-' || substr(sha1(ts || '|' || action || '|' || principal), 1, 12) AS stable_id FROM ev",
          lambda e: e.select("event_id", fields.stable_id("sl", F.col("ts"), F.col("action"), F.col("principal")).alias("stable_id")))
on_events("rendered_lines", f"SELECT event_id, {LINE} AS line FROM ev",
          lambda e: e.select("event_id", fields.render_line({c: F.col(c) for c in e.columns}).alias("line")))
on_events("valid_events", "SELECT count(*) AS n_valid FROM ev", lambda e: e.agg(F.count_if(fields.valid_event(SOURCES)).alias("n_valid")))
on_events("upsert_dedup", "SELECT principal AS event_id, max_by(action, event_id) AS action FROM ev GROUP BY 1",
          lambda e: tables.upsert(e.select(F.col("principal").alias("event_id"), "action", F.col("event_id").alias("_seq")), "event_id", "_seq"))
on_events("resume_antijoin", "SELECT event_id FROM ev WHERE action <> 'click'", lambda e: tables.missing(e.select("event_id"), e.filter("action = 'click'"), "event_id"))
on_events("bursts", """, t AS (SELECT principal, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s FROM ev),
  c AS (SELECT principal, count(*) OVER (PARTITION BY principal ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM t) SELECT principal, max(n) AS burst FROM c GROUP BY 1 HAVING max(n) >= 3""",
          lambda e: evaluate.bursts(e, 60, 3))
on_events("failure_then_success", """, t AS (SELECT *, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s FROM ev),
  l AS (SELECT *, max(CASE WHEN status = 'failure' THEN s END) OVER (PARTITION BY principal ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM t)
  SELECT event_id, principal, ts FROM l WHERE action = 'purchase' AND s - f <= 3600""", lambda e: evaluate.failure_then_success(e, "purchase", 60))

on_events("timeline", "SELECT ts[1:13] AS bucket, count(*) AS n, count(*) FILTER (status = 'failure') AS failures FROM ev GROUP BY 1", evaluate.timeline)
on_events("steps_within", """, a AS (SELECT source, ts, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s, action FROM ev WHERE action IN ('StopLogging', 'DeleteTrail'))
  SELECT x.source, min(greatest(x.ts, y.ts)) AS ts FROM a x JOIN a y ON x.source = y.source AND x.action = 'StopLogging' AND y.action = 'DeleteTrail' AND abs(x.s - y.s) <= 864000 GROUP BY 1""",
          lambda e: evaluate.steps_within(e, ["source"], ["StopLogging", "DeleteTrail"], 14400))
on_events("different_within", """, a AS (SELECT *, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s FROM ev WHERE status = 'failure'),
  b AS (SELECT x.region, x.ts, count(DISTINCT y.principal) AS n FROM a x JOIN a y ON x.region = y.region AND y.s BETWEEN x.s - 43200 AND x.s GROUP BY x.region, x.ts, x.event_id) SELECT region, min(ts) AS ts FROM b WHERE n >= 3 GROUP BY 1""",
          lambda e: evaluate.different_within(e.filter("status = 'failure'"), ["region"], "principal", 720, 3))
on_events("steps_in_order", """, t AS (SELECT principal, event_id, ts, action, epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS s, row_number() OVER (PARTITION BY principal ORDER BY ts, event_id) AS rn FROM ev),
  state AS (SELECT principal, event_id, ts, rn, action, s, CASE WHEN action = 'view' THEN s END AS viewed, CAST(NULL AS DOUBLE) AS clicked FROM t WHERE rn = 1
    UNION ALL SELECT t.principal, t.event_id, t.ts, t.rn, t.action, t.s, CASE t.action WHEN 'view' THEN t.s WHEN 'error' THEN NULL ELSE viewed END,
      CASE t.action WHEN 'click' THEN viewed WHEN 'error' THEN NULL ELSE clicked END FROM state JOIN t ON t.principal = state.principal AND t.rn = state.rn + 1)
  SELECT principal, event_id, ts, CAST(clicked AS BIGINT) AS began FROM state WHERE action = 'purchase' AND s - clicked <= 172800""",
          lambda e: evaluate.steps_in_order(e, ["principal"], ["view", "click", "purchase"], 2880, ["error"]))
ORACLE_SQL["steps_in_order"] = ORACLE_SQL["steps_in_order"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("uncited", f"""SELECT DISTINCT doc_id, cited FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{evaluate.MAIL}')) AS cited FROM documents)
  WHERE cited NOT IN (SELECT unnest(regexp_extract_all(html, '{evaluate.MAIL}')) FROM pages)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that documents cite and no page has."""
    known = table(spark, d, "pages").select(F.explode(evaluate.citations(F.col("html"), evaluate.MAIL, 0)).alias("mail"))
    return evaluate.uncited(table(spark, d, "documents"), "doc_id", known, "mail", shape=evaluate.MAIL, group=0)


@contextmanager
def stored_days(spark: SparkSession, rows: DataFrame):
    """The rows as a table kept by day, dropped at the end."""
    path = shared.new_folder(spark, "days")
    try:
        days.merge(spark, path, rows, "event_id")
        yield path
    finally:
        shared.drop(spark, path)


@query("between_stored", ORACLE_SQL["events_between"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same span from a table kept by day, of which two days are read."""
    rows = app_events(spark, d)
    with stored_days(spark, rows) as path:
        stored = days.read(spark, path, rows.schema)
        return shared.cut(tables.between(stored, "2024-01-05", "2024-01-06", status="failure").select("event_id", "ts", "action", "principal"))


@query("merge_days", f"""WITH {EV}, n AS (SELECT *, CAST(substr(event_id, 4) AS BIGINT) AS n FROM ev)
  SELECT event_id, CASE WHEN n % 1000 = 0 THEN '2024-01-03T00:00:00Z' ELSE ts END AS ts, CASE WHEN n % 100 = 0 THEN 'merged' ELSE action END AS action, principal FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth event written again, every thousandth at another time, merged into all that are stored."""
    rows, n = app_events(spark, d), F.substring("event_id", 4, 20).cast("long")
    fresh = rows.filter(n % 100 == 0).withColumn("action", F.lit("merged")).withColumn("ts", F.when(n % 1000 == 0, "2024-01-03T00:00:00Z").otherwise(F.col("ts")))
    with stored_days(spark, rows) as path:
        days.merge(spark, path, fresh, "event_id")
        return shared.cut(days.read(spark, path, rows.schema).select("event_id", "ts", "action", "principal"))


@query("windows_incremental", f"WITH RECURSIVE {EV}{W720} SELECT ts_start, ts_end, source, principal, src_ip, n_events, n_failures, risk_score, event_names, accounts FROM agg")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All windows of a store whose last events (each hundredth, and each thousandth that stood elsewhere before) came later."""
    rows, n = app_events(spark, d), F.substring("event_id", 4, 20).cast("long")
    before = rows.filter(n % 100 != 0).withColumn("ts", F.when(n % 1000 == 1, "2024-01-03T00:00:00Z").otherwise(F.col("ts")))
    out = shared.new_folder(spark, "store")
    try:
        days.merge(spark, f"{out}/events", before, "event_id")
        ingest.build_all(spark, out, 720, 4800, 10, True)
        # Read several times, and few of all events.
        ingest.advance(spark, out, shared.cut(rows.filter((n % 100 == 0) | (n % 1000 == 1))), 720, 4800, 10)
        named = (F.array_join(c, ",").alias(c) for c in ("event_names", "accounts"))
        return shared.cut(ingest.stored_windows(spark, out).select("ts_start", "ts_end", "source", "principal", "src_ip", "n_events", "n_failures", "risk_score", *named))
    finally:
        shared.drop(spark, out)


@query("events_of_id_table", f"WITH {EV} SELECT event_id, ts, action FROM ev WHERE event_id IN (SELECT 'ev-' || doc_id FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("ev-"), F.col("doc_id").cast("string")).alias("event_id"))
    return tables.by_ids(app_events(spark, d), "event_id", ids).select("event_id", "ts", "action")


_W = ["chunk_id", "ts_start", "ts_end", "source", "principal", "src_ip", "n_events", "n_failures", "risk_score"]
_named = lambda w: w.select(*_W, *(F.array_join(c, ",").alias(c) for c in ("event_names", "accounts")))
_sql = f"SELECT {', '.join(_W)}, event_names, accounts FROM agg"
on_windows("windows_720m_capped", _sql, _named)
on_windows("windows_15m", _sql, _named, W15, 15, 120)
on_windows("windows_char_cap", _sql, _named, WCHARS, 1440, 120, 300)
on_windows("window_membership", "SELECT chunk_id, event_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY ts, event_id) - 1 AS INTEGER) AS position FROM win", windows.membership)
on_windows("top_risk_windows", f"SELECT {', '.join(_W)} FROM agg ORDER BY risk_score DESC, n_events DESC, chunk_id LIMIT 10",
           lambda w: w.orderBy(F.desc("risk_score"), F.desc("n_events"), "chunk_id").limit(10).select(*_W))
on_windows("summarize_windows", """SELECT count(*) AS windows, coalesce(sum(n_events), 0) AS events, coalesce(sum(n_failures), 0) AS failures, count(*) FILTER (risk_score >= 50) AS high_risk,
  coalesce(max(risk_score), 0) AS max_risk, coalesce(max(n_events), 0) AS max_events FROM agg""", windows.summarize)
on_windows("percentiles_window_size", "SELECT quantile_cont(n_events, 0.5) AS p50, quantile_cont(n_events, 0.9) AS p90 FROM agg", windows.sizes)
on_windows("windows_by_ids", f"SELECT {', '.join(_W)} FROM agg WHERE chunk_id IN ('w-00001', 'w-00005')", lambda w: tables.by_ids(w, "chunk_id", ["w-00005", "w-00001", "", "w-00001"]).select(*_W))
on_windows("window_text", """SELECT chunk_id, '[WINDOW ' || chunk_id || '] ' || any_value(a.ts_start) || ' -> ' || any_value(a.ts_end) || ' | source=' || any_value(a.source) || ' | principal=' || any_value(a.principal)
  || ' | src_ip=' || coalesce(nullif(any_value(a.src_ip), ''), '-') || ' | events=' || any_value(n_events) || ' | failures=' || any_value(n_failures) || ' | risk=' || any_value(risk_score)
  || chr(10) || string_agg('- ' || line, chr(10) ORDER BY w.ts, event_id) AS text FROM win w JOIN agg a USING (chunk_id) GROUP BY chunk_id""",
           lambda w: w.select("chunk_id", "text"))

on_windows("windows_by_source", "SELECT source, count(*) AS windows, CAST(sum(n_events) AS BIGINT) AS events FROM agg GROUP BY 1", windows.by_source)
on_windows("window_risk", "SELECT chunk_id, risk_score FROM agg", lambda w: w.select("chunk_id", "risk_score"))
on_windows("high_risk_windows", f"SELECT {', '.join(_W)} FROM agg WHERE risk_score >= 50", lambda w: w.filter("risk_score >= 50").select(*_W))
on_windows("window_search_text", """SELECT chunk_id, lower(any_value(a.source) || ' ' || any_value(a.principal) || ' ' || any_value(a.src_ip) || ' ' || replace(any_value(event_names), ',', ' ') || ' ' || replace(any_value(accounts), ',', ' ')
  || ' ' || string_agg(concat_ws(' ', action, nullif(w.principal, ''), nullif(w.src_ip, ''), nullif(resource, ''), nullif(region, ''), event_id, CASE status WHEN 'failure' THEN 'failure failed error denied' END), ' ' ORDER BY w.ts, event_id)) AS search_text
  FROM win w JOIN agg a USING (chunk_id) GROUP BY chunk_id""",
           lambda w: w.select("chunk_id", "search_text"))


@query("events_of_window", f"WITH RECURSIVE {EV}{W720} SELECT event_id, ts, action, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS INTEGER) AS position FROM win WHERE chunk_id = 'w-00003'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return windows.events_of_window(app_windows(spark, d), app_events(spark, d), "w-00003").select("event_id", "ts", "action", "position")


@query("table_counts", f"""WITH RECURSIVE {EV}{W720} SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'windows', count(*) FROM agg UNION ALL SELECT 'window_events', count(*) FROM win""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = app_windows(spark, d)
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one(app_events(spark, d), "events").unionByName(one(w, "windows")).unionByName(one(windows.membership(w), "window_events"))


@query("detect_source", r"""SELECT page_id, CASE WHEN regexp_matches(name, '\.(json|jsonl|ndjson)$') THEN 'cloudtrail' WHEN regexp_matches(name, '\.(log|txt|out)$') OR regexp_matches(name, '^(auth|syslog|ssh)') THEN 'syslog'
  ELSE 'cloudtrail' END AS family, NOT starts_with(name, '.') AND regexp_matches(name, '\.(json|jsonl|ndjson|log|txt|out)$') AND name <> 'manifest.json' AS is_log
  FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the names of the pages' files say."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, d, "pages").select("page_id", detect_source(name).alias("family"), is_log_file(name).alias("is_log"))


@query("tokenize", f"WITH {TOK} SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM tok")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = fields.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(t, " ")).alias("terms_md5"))


@query("postings", f"WITH {TOK}{POST} SELECT doc_id, CAST(dl AS INTEGER) AS dl, term, tf FROM post")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"), "doc_id").filter("term is not null").select("doc_id", "dl", "term", "tf")


@query("bm25_idf", f"WITH {TOK}{POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark: SparkSession, d: str) -> DataFrame:
    # The counts are read three times.
    return retrieval.idf_of(shared.cut(retrieval.frequencies(table(spark, d, "documents"), "doc_id"))).withColumn("idf", F.round("idf", 6))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", QUESTION)


def _vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def _dense(spark: SparkSession, d: str, where=None) -> DataFrame:
    return retrieval.dense(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", _vector(spark, d), where=where)


query("bm25_topk", f"WITH {TOK}{POST}{BM} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")(_bm25)
@query("bm25_stored", f"WITH {TOK}{POST}{BM} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same question from a stored inverted index, which is built from the whole table and dropped."""
    path = shared.new_folder(spark, "postings")
    try:
        inverted_index.write(table(spark, d, "documents"), "doc_id", path)
        return shared.cut(inverted_index.search(spark, path, QUESTION, key="doc_id"))
    finally:
        shared.drop(spark, path)


query("dense_topk", f"WITH {DENSE.format(where='')} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM den")(_dense)
query("dense_topk_filtered", f"WITH {DENSE.format(where='WHERE label = 3')} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM den")(lambda spark, d: _dense(spark, d, F.col("label") == 3))
_fused = "SELECT doc_id, score, sources, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fused ORDER BY score DESC, doc_id LIMIT 50"
for _name, _b, _d in (("rrf_fusion", 1.0, 1.0), ("rrf_weighted", 0.3, 0.7)):
    query(_name, f"WITH {TOK}{POST}{BM}, {DENSE.format(where='')}{FUSE.format(b=_b, d=_d)} {_fused}")(
        lambda spark, d, b=_b, v=_d: retrieval.fuse({"bm25": _bm25(spark, d), "dense": _dense(spark, d)}, "doc_id", weights={"bm25": b, "dense": v}))


@query("hybrid_retrieve", f"""WITH {TOK}{POST}{BM}, {DENSE.format(where='')}{FUSE.format(b=1.0, d=1.0)}, top AS ({_fused})
  SELECT top.doc_id, top.score, sources, top.rank, CAST(den.rank AS INTEGER) AS dense_rank, CAST(bm.rank AS INTEGER) AS bm25_rank, 0.0::DOUBLE AS rerank_score
  FROM top JOIN documents USING (doc_id) LEFT JOIN den USING (doc_id) LEFT JOIN bm USING (doc_id) WHERE top.rank <= 10""")
def _(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieve(table(spark, d, "documents"), vectors, "doc_id", QUESTION, _vector(spark, d), k=10).select("doc_id", "score", "sources", "rank", "dense_rank", "bm25_rank", "rerank_score")


@query("dense_topk_batch", """SELECT question, key, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM (
  SELECT q.vec_id AS question, v.vec_id AS key, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 50""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of each vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings")
    return vector_index.exact(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id")


@query("ann_topk")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same questions by the partitioned index, which is built from the whole table and dropped; recall is tested."""
    vectors, path = table(spark, d, "embeddings"), shared.new_folder(spark, "vectors")
    try:
        vector_index.build(vectors, "vec_id", path)
        return shared.cut(vector_index.search(spark, path, vectors.filter("vec_id % 100 = 0"), "vec_id"))
    finally:
        shared.drop(spark, path)


@query("rerank_null", f"WITH {DENSE.format(where='')} SELECT doc_id, score, CAST(rank AS INTEGER) AS rank, 0.0::DOUBLE AS rerank_score FROM den")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_dense(spark, d), "doc_id")


@query("rerank_head", f"""WITH {DENSE.format(where='')} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY rank > 10, CASE WHEN rank <= 10 THEN doc_id % 7 END DESC NULLS LAST, rank) AS INTEGER) AS rank,
  CASE WHEN rank <= 10 THEN CAST(doc_id % 7 AS DOUBLE) END AS rerank_score FROM den""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first 10 of the dense list by a stand-in for a model's score."""
    return retrieval.rerank(_dense(spark, d), "doc_id", lambda hits: hits.withColumn("rerank_score", (F.col("doc_id") % 7).cast("double")), top_n=10)


@query("vocabulary_size", f"WITH {TOK}{POST} SELECT count(DISTINCT term) AS n_terms FROM post")
def _(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(table(spark, d, "documents")).agg(F.count("term").alias("n_terms"))


@query("recall_mrr", f"""WITH {TOK}{POST}{BM}, truth AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), hit AS (SELECT rank FROM bm JOIN truth USING (doc_id)),
  n AS (SELECT greatest(count(*), 1) AS n FROM truth) SELECT round(count(*) FILTER (rank <= 1) / any_value(n), 6) AS recall_1, round(count(*) FILTER (rank <= 3) / any_value(n), 6) AS recall_3,
  round(count(*) FILTER (rank <= 5) / any_value(n), 6) AS recall_5, round(coalesce(1.0 / min(rank), 0), 6)::DOUBLE AS mrr FROM n LEFT JOIN hit ON true""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_mrr(_bm25(spark, d), table(spark, d, "labels").filter("quality = 1"), "doc_id")


QA = """, q AS (SELECT item_id AS question, term, count(*) AS times FROM (SELECT item_id, unnest(t) AS term FROM qtok) GROUP BY ALL),
  scored AS (SELECT question, doc_id AS key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(t)) FROM tok)))), 6) AS score
    FROM post JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM scored)"""


@query("bm25_questions", f"WITH {TOK}, {TOK.replace('tok AS', 'qtok AS', 1).replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')}{POST}{QA} SELECT question, key, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as questions to all documents."""
    return inverted_index.search_all(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text"))


@query("recall_mrr_questions", """WITH near AS (SELECT question, key, truth, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM (
    SELECT q.vec_id AS question, v.vec_id AS key, q.label = v.label AND q.vec_id <> v.vec_id AS truth, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)),
  each AS (SELECT question, count(*) AS n, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 20) AS h20, count(*) FILTER (rank <= 50) AS h50, min(rank) AS first FROM near WHERE truth GROUP BY 1)
  SELECT count(*) AS questions, round(avg(h5 / n), 6) AS recall_5, round(avg(h20 / n), 6) AS recall_20, round(avg(h50 / n), 6) AS recall_50, round(avg(CASE WHEN first <= 50 THEN 1.0 / first ELSE 0 END), 6)::DOUBLE AS mrr FROM each""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How often the neighbours of a vector have its label, over all vectors whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0")
    items, labels = vectors.select(F.col("vec_id").alias("key"), "label"), asked.select(F.col("vec_id").alias("question"), "label")
    return evaluate.recall_mrr_labels(vector_index.exact(vectors, asked, "vec_id"), items, labels, (5, 20, 50))


@query("redaction", rf"""SELECT doc_id, md5(line) AS text_md5, len(string_split(line, '[MAIL]')) - 1 AS n_mails FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  coalesce(text, ''), '(AKIA|ASIA)[0-9A-Z]{{16}}', '[ACCESS_KEY]', 'g'), '(?i)bearer +[a-z0-9._-]{{8,}}', '[BEARER]', 'g'), '(?i)password=[^ ]+', 'password=[REDACTED]', 'g'), '{evaluate.MAIL}', '[MAIL]', 'g') AS line FROM documents)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts without secrets and addresses."""
    line = F.col("line")
    rows = table(spark, d, "documents").select("doc_id", evaluate.redact(F.coalesce("text", F.lit("")), [(evaluate.MAIL, "[MAIL]")]).alias("line"))
    return rows.select("doc_id", F.md5(line).alias("text_md5"), (F.size(F.split(line, r"\[MAIL\]")) - 1).cast("long").alias("n_mails"))


@query("injection", r"""SELECT doc_id, regexp_matches(lower(t), 'ignore (all |any )?(previous|prior|above) instructions|disregard (the |your )?(system|previous)|you are now|system prompt|</?(system|assistant|user)>') AS flagged
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ignore all previous instructions ' WHEN 1 THEN '<System> ' ELSE '' END || coalesce(text, '') AS t FROM documents)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("doc_id") % 4 == 0, "Ignore all previous instructions ").when(F.col("doc_id") % 4 == 1, "<System> ").otherwise("")
    return table(spark, d, "documents").select("doc_id", evaluate.injection(F.concat(lead, F.coalesce("text", F.lit("")))).alias("flagged"))
