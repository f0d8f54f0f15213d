import hashlib
import json
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom import registry
from logloom.functions import fields
from logloom import settings
from logloom.operators import evaluate, retrieval, tables, windows
from logloom.plans import ingest, models, render
from logloom.sources import logs

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "embeddings", "labels", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["top_principals", "events_between", "failure_pct", "stable_ids", "windows_720m_capped", "window_membership", "tokenize", "bm25_topk", "rrf_weighted", "detect_source", "rendered_lines", "window_text", "window_search_text", "windows_char_cap", "windows_by_source", "top_src_ips", "timeline", "steps_within", "different_within", "uncited", "injection"])
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, D)
    rel = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def event(i, ts, action="a", status="info", principal="p", ip=""):
    return (f"e{i}", ts, "auth", action, status, principal, ip, "", "", "", "", "", "", "")


def frame(spark, rows):
    from logloom.schemas import EVENT
    return spark.createDataFrame(rows, EVENT)


def test_gap_is_inclusive_and_keys_are_apart(spark):
    rows = [event(1, "2024-01-01T00:00:00Z"), event(2, "2024-01-01T00:15:00Z"), event(3, "2024-01-01T00:30:01Z"), event(4, "2024-01-01T00:01:00Z", principal="q")]
    got = {tuple(r["event_ids"]) for r in windows.build_windows(frame(spark, rows)).collect()}
    assert got == {("e1", "e2"), ("e3",), ("e4",)}


def test_caps_and_numbers(spark):
    rows = [event(i, f"2024-01-0{1 + i // 5}T00:00:0{i % 5}Z") for i in range(10)]
    got = windows.build_windows(frame(spark, rows), max_events=2).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == [f"w-{i:05d}" for i in range(1, 7)]
    assert [r["n_events"] for r in got] == [2, 2, 1, 2, 2, 1]


def test_risk(spark):
    rows = [event(1, "2024-01-01T00:00:00Z", "StopLogging", "failure", "arn:aws:iam::1:root"), event(2, "2024-01-01T00:00:01Z", "StopLogging", "failure", "arn:aws:iam::1:root")]
    row = windows.build_windows(frame(spark, rows)).first()
    assert row["risk_score"] == 40 + 4 + 25 and row["text"].startswith("[WINDOW w-00001] 2024-01-01T00:00:00Z -> ") and "failure failed error denied" in row["search_text"]


def test_status_and_tokens(spark):
    row = spark.range(1).select(*(fields.normalize_status(F.lit(x)).alias(f"c{i}") for i, x in enumerate(["", "OK", "AccessDenied", "Out of memory", "fine", " failed "])),
                                fields.tokenize(F.lit("ConsoleLogin from 10.0.0.1 /usr/bin/systemctl")).alias("t")).first()
    assert [row[f"c{i}"] for i in range(6)] == ["info", "success", "failure", "failure", "info", "failure"]
    assert row["t"] == ["consolelogin", "console", "login", "from", "10.0.0.1", "usr/bin/systemctl", "usr", "bin", "systemctl"]


def test_parsers_and_ingest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    one = {"eventID": "1", "eventTime": "2026-01-01T00:00:00+00:00", "eventName": "CreateUser", "eventSource": "iam", "awsRegion": "r", "sourceIPAddress": "1.2.3.4", "readOnly": False,
           "userIdentity": {"arn": "arn:x", "accountId": "9", "type": "IAMUser"}, "requestParameters": {"userName": "bob"}, "errorCode": "AccessDenied"}
    (raw / "cloudtrail.json").write_text(json.dumps([one, {"eventName": "no time"}]))
    (raw / "more.jsonl").write_text(json.dumps(one | {"eventID": "2", "errorCode": None}) + "\nnot json\n\n")
    (raw / "manifest.json").write_text("{}")
    lines = ["Aug 14 02:11:03 h sshd[1]: Failed password for invalid user bob from 9.9.9.9 port 22 ssh2", "Aug  4 02:11:03 h sshd[1]: Accepted publickey for al from 8.8.8.8 port 22",
             "Aug 14 02:11:04 h sudo: al : TTY=x ; COMMAND=/bin/ls", "Aug 14 02:11:05 h CRON[3]: (root) CMD (run it)", "Aug 14 02:11:06 h kernel: Out of memory: killed", "Feb 30 02:11:06 h kernel: x", "junk"]
    (raw / "auth.log").write_text("\n".join(lines))
    events, counters = logs.load_events(spark, str(raw), 2026)
    by = {r["event_id"] if r["source"] == "cloudtrail" else r["action"]: r for r in events.collect()}
    assert by["sshd.failed_password"]["event_id"] == "sl-" + hashlib.sha1(f"auth.log:1|{lines[0]}".encode()).hexdigest()[:12] and by["sshd.failed_password"]["raw_ref"] == "auth.log:1"
    assert by["ct-1"]["raw_ref"] == "cloudtrail.json:1" and by["ct-2"]["raw_ref"] == "more.jsonl:1"
    assert by["ct-1"]["status"] == "failure" and by["ct-1"]["resource"] == "userName=bob" and by["ct-1"]["ts"] == "2026-01-01T00:00:00Z" and by["ct-2"]["status"] == "success"
    assert by["sshd.failed_password"]["principal"] == "bob" and by["sshd.accepted_password"]["ts"] == "2026-08-04T02:11:03Z" and by["kernel.message"]["status"] == "failure"
    assert by["sudo.command"]["resource"] == "/bin/ls" and by["cron.job"]["principal"] == "root"
    assert counters.get() == {"files": 3, "records": 10, "skipped": 4}
    report = ingest.ingest(spark, str(raw), str(tmp_path / "out"), 2026)
    again = ingest.ingest(spark, str(raw), str(tmp_path / "out"), 2026)
    assert report["events"] == 7 and {k: v for k, v in report.items() if k != "seconds"} == {k: v for k, v in again.items() if k != "seconds"}
    assert report["by_source"] == {"auth": 5, "cloudtrail": 2} and sum(report["windows_by_source"].values()) == report["windows"]
    assert ingest.get_meta(spark, str(tmp_path / "out"))["schema_version"] == str(ingest.SCHEMA_VERSION)
    done = ingest.index(spark, str(tmp_path / "out"), ingest.hashed_embedding)
    assert done["embedded"] == report["windows"] == done["vectors"] and ingest.index(spark, str(tmp_path / "out"), ingest.hashed_embedding)["skipped_existing"] == report["windows"]
    built = spark.read.parquet(str(tmp_path / "out" / "windows"))
    for row in built.collect():
        assert all(i in row["text"] for i in row["event_ids"])
    assert ingest.write_jsonl(built, str(tmp_path / "w.jsonl")) == report["windows"]
    with open(tmp_path / "w.jsonl" / "more.json", "w") as f:
        f.write('not json\n{"chunk_id": "w-9", "new": 1}\n')
    back = ingest.read_jsonl(spark, str(tmp_path / "w.jsonl"))
    assert {tuple(map(str, r)) for r in back.filter("chunk_id <> 'w-9'").select(*built.columns).collect()} == {tuple(map(str, r)) for r in built.collect()} and back.count() == report["windows"] + 1
    again = ingest.from_records(ingest.as_records(built), built.schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, built.collect()))
    ingest.drop_tables(spark, str(tmp_path / "out"))
    assert ingest.stored(spark, str(tmp_path / "out" / "events")) is None


def test_fusion_and_upsert(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = retrieval.fuse({"a": a, "b": b}, "id").collect()
    assert [(r["id"], r["sources"]) for r in got] == [("y", "a,b"), ("x", "a")]
    with pytest.raises(ValueError):
        retrieval.fuse({"a": a}, "id", k=0)
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "id string, seq int, v string")
    assert tables.upsert(rows, "id", "seq").first()["v"] == "new"


def test_long_documents_are_read_whole(spark):
    """A query term that stands only after 512 others is counted and found; a cap is kept where one is given."""
    docs = spark.createDataFrame([(1, "filler " * 600 + "needle"), (2, "short text"), (3, "other")], "id long, text string")
    assert {(r["term"], r["tf"], r["dl"]) for r in retrieval.postings(docs, "id").filter("id = 1").collect()} == {("filler", 600, 601), ("needle", 1, 601)}
    assert [r["id"] for r in retrieval.bm25(docs, "id", "needle").collect()] == [1] and retrieval.bm25(docs, "id", "needle", max_tokens=512).count() == 0
    assert retrieval.term_counts(docs, max_tokens=0).filter("term is null").first()["dl"] == 604


def test_partitions_do_not_change_windows(spark):
    one = {tuple(r) for r in registry.app_windows(spark, D).select("chunk_id", "ts_start", "principal").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    two = {tuple(r) for r in registry.app_windows(spark, D).select("chunk_id", "ts_start", "principal").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two


def test_windows_of_long_sessions_are_those_of_one_pass(spark):
    """Sessions over midnight and beyond both caps, against the rules read line by line."""
    import random
    draw = random.Random(4)
    rows = []
    for p in ("p", "q", ""):
        at = 1_704_060_000
        for i in range(400):
            at += draw.choice([1, 30, 400, 899, 900, 901, 4000]) if p else 300
            rows.append(event(f"{p}{i}", datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), draw.choice("ab") * draw.randint(1, 60), principal=p))
    build = lambda **more: windows.build_windows(frame(spark, rows).repartition(5), 15, max_chars=700, max_events=9, start_index=3, **more).collect()
    got = build()
    for more in ({"hot_key": 399}, {"hot_key": 399, "block": 9}, {"hot_key": 100, "block": 13}):
        assert sorted(map(str, got)) == sorted(map(str, build(**more)))
    want, text = [], lambda r: " | ".join([r[1], r[3], "INFO", r[5] or "-", "-", "-", r[0]])
    groups = []
    for p in ("", "p", "q"):
        own, last = sorted((r for r in rows if r[5] == p), key=lambda r: (r[1], r[0])), None
        for r in own:
            now = datetime.fromisoformat(r[1])
            if last is None or (now - last).total_seconds() > 900:
                groups.append([])
            groups[-1].append(r)
            last = now
    for g in sorted(groups, key=lambda g: (g[0][1], g[0][5])):
        piece, chars = [], 0
        for r in g:
            if piece and (chars + len(text(r)) + 3 > 700 or len(piece) >= 9):
                want.append(piece)
                piece, chars = [], 0
            piece.append(r[0])
            chars += len(text(r)) + 3
        want.append(piece)
    assert {r["chunk_id"]: r["event_ids"] for r in got} == {f"w-{i:05d}": w for i, w in enumerate(want, 3)} and len(want) > 100


def test_records_keep_their_extras(spark, tmp_path):
    rows = [{"eventID": " 7 ", "eventTime": "2026-01-01T01:00:00+02:00", "eventName": "A", "errorMessage": "went wrong"},
            {"eventTime": "2026-01-01T00:00:00Z", "eventName": "B", "errorCode": "Denied", "readOnly": True}, {"eventName": "no time"}, 5]
    (tmp_path / "day.json").write_text(json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(["", json.dumps(rows[1]), "{broken", json.dumps(rows[0] | {"eventID": "8"})]) + "\n")
    (tmp_path / "bad.json").write_text("[1, 2")
    (tmp_path / "empty.log").write_text("")
    events, counters = logs.load_events(spark, [str(tmp_path)], 2026)
    by = {r["raw_ref"]: r for r in events.collect()}
    assert sorted(by) == ["day.json:1", "day.json:2", "lines.jsonl:1", "lines.jsonl:2"]
    one, two = (json.loads(by[k]["extra"]) for k in ("day.json:1", "day.json:2"))
    assert (by["day.json:1"]["event_id"], by["day.json:1"]["ts"], one["error_code"], one["read_only"], by["day.json:1"]["status"]) == ("ct-7", "2025-12-31T23:00:00Z", "went wrong", False, "success")
    assert two["read_only"] is True and two["error_code"] == "Denied" and by["day.json:2"]["event_id"].startswith("ct-") and by["lines.jsonl:2"]["event_id"] == "ct-8"
    assert counters.get() == {"files": 4, "records": 6, "skipped": 4}
    named, _ = logs.load_events(spark, [str(tmp_path / "lines.jsonl"), str(tmp_path / "lines.jsonl")], 2026)
    assert named.count() == 2 and logs.load_events(spark, [str(tmp_path / "empty.log")], 2026)[0].count() == 0


def test_lines_are_numbered_however_files_are_split(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 700)):
        (tmp_path / name).write_text("".join(f"{'x' * (i % 60)} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.numbered_lines(spark, logs.discover(spark, [str(tmp_path)]))
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == 5700
        assert rows.filter("i <> cast(element_at(split(line, ' '), -1) as long)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def write_attacks(folder):
    """Raw files with one actor for each kind of attack, and next to it one that stays just below it."""
    day, records, kinds = datetime(2031, 5, 6, tzinfo=timezone.utc), [], {}

    def put(second, action, user, ip, error="", arn=None):
        who = {"arn": arn or f"arn:aws:iam::77:user/{user}", "type": "IAMUser"}
        records.append({"eventID": f"n{len(records)}", "eventTime": (day + timedelta(seconds=second)).isoformat(), "eventName": action, "sourceIPAddress": ip, "userIdentity": who} | ({"errorCode": error} if error else {}))

    def run(kind, user, ip, steps):
        kinds[kind] = (f"arn:aws:iam::77:user/{user}", ip)
        for i, (action, gap) in enumerate(steps):
            put(i * gap, action, user, ip)
    for user, n in (("zed", 20), ("yan", 19)):
        for i in range(n):
            put(i * 30, "ConsoleLogin", user, "5.5.5.5", "Failed")
        put(3000, "ConsoleLogin", user, "5.5.5.5")
    kinds["console_brute_force"] = ("arn:aws:iam::77:user/zed", "5.5.5.5")
    run("iam_privilege_escalation", "una", "5.5.5.6", [("AttachUserPolicy", 500), ("CreateUser", 500), ("CreateAccessKey", 500)])
    run("s3_bucket_public", "vic", "5.5.5.7", [("PutBucketPolicy", 60), ("PutBucketAcl", 60)])
    run("security_group_open_to_world", "wes", "5.5.5.8", [("AuthorizeSecurityGroupIngress", 900)] * 3)
    run("logging_tampering", "xia", "5.5.5.9", [("StopLogging", 60), ("DeleteTrail", 60)])
    put(0, "StopLogging", "slow", "5.5.6.0")
    put(3700, "DeleteTrail", "slow", "5.5.6.0")
    put(9, "ConsoleLogin", "", "5.5.6.1", arn="arn:aws:iam::77:root")
    kinds["root_account_usage"] = ("arn:aws:iam::77:root", "5.5.6.1")
    for i in range(8):
        put(i * 100, "AssumeRole", f"many{i}", "5.5.6.2", "AccessDenied")
        put(i * 300, "AssumeRole", f"rare{i}", "5.5.6.3", "AccessDenied")
    kinds["credential_stuffing"] = ("", "5.5.6.2")
    for i in range(3):
        put(i * 200, "ConsoleLogin", "far", f"6.6.{i}.1")
        put(i * 500, "ConsoleLogin", "near", f"6.7.{i}.1")
    kinds["impossible_travel"] = ("arn:aws:iam::77:user/far", "")
    for i in range(500):
        put(i * 3, "GetObject", "bulk", "5.5.6.4")
        put(i * 4, "GetObject", "calm", "5.5.6.5")
    kinds["s3_data_exfiltration"] = ("arn:aws:iam::77:user/bulk", "5.5.6.4")
    (folder / "audit-1.json").write_text(json.dumps(records[::2], indent=1))
    (folder / "audit-2.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records[1::2]))
    ssh = [f"May  6 01:{i:02d}:00 box sshd[9]: Failed password for ops from 8.8.4.4 port 9 ssh2" for i in range(20)] + ["May  6 01:30:00 box sshd[9]: Accepted password for ops from 8.8.4.4 port 9 ssh2"]
    (folder / "auth.log").write_text("\n".join(ssh))
    kinds["ssh_brute_force"] = ("ops", "8.8.4.4")
    (folder / "manifest.json").write_text('{"end_date": "2031-05-06"}')
    return kinds, len(records) + len(ssh)


def test_attacks_are_detected(spark, tmp_path):
    """Each kind once and nothing else, from raw files to detections; the year comes from the manifest."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    kinds, n = write_attacks(raw)
    assert logs.resolve_year(spark, [str(raw)]) == 2031 and logs.resolve_year(spark, [str(tmp_path / "none")], 1999) == 1999
    report = ingest.ingest(spark, str(raw), out)
    assert report["records"] == report["events"] == n and report["skipped"] == 0 and report["assumed_year"] == 2031 and report["files"] == 3
    found = {r["type"]: (r["principal"], r["src_ip"]) for r in evaluate.detections(spark.read.parquet(f"{out}/events")).collect()}
    assert found == kinds and len(kinds) == 10
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, str(tmp_path / "none"), out, rebuild=True)
    assert spark.read.parquet(f"{out}/events").count() == n


def test_retrieval_contracts(spark):
    """Blank questions ask nobody; windows that the store lacks are counted; each stage says what it did."""
    docs = spark.createDataFrame([(f"w-{i}", "failed password " * i) for i in range(1, 4)], "id string, text string")
    vectors = spark.createDataFrame([(f"w-{i}", [1.0, float(i)]) for i in range(1, 4)] + [("w-ghost", [1.0, 1.0])], "id string, embedding array<double>")
    report = {}
    got = ingest.retrieve(docs, vectors, "id", "failed password", [1.0, 1.0], k=2, report=report).collect()
    assert len(got) == 2 and "w-ghost" not in {r["id"] for r in got}
    assert (report["k"], report["dense_candidates"], report["bm25_candidates"], report["fused_candidates"], report["missing_from_store"], report["rerank_applied"]) == (2, 4, 3, 4, 1, False)
    assert set(report["timings_ms"]) == {"dense_ms", "bm25_ms", "fused_ms", "total_ms"}
    assert ingest.retrieve(docs, None, "id", "  \n", [], report=report).collect() == [] and report["dense_candidates"] == 0
    assert set(ingest.retrieve(docs, vectors, "id", " ", []).columns) == set(got[0].asDict())
    rows = ingest.hashed_embedding(spark.createDataFrame([("to be or not to be ConsoleLogin",), ("",), (None,)], "text string")).collect()
    spots = [r[0] for r in spark.createDataFrame([(t,) for t in "to be or not to be consolelogin console login".split()], "t string").select(F.pmod(F.xxhash64("t"), F.lit(64))).collect()]
    norm = sum(spots.count(i) ** 2 for i in range(64)) ** 0.5
    assert rows[0]["embedding"] == pytest.approx([spots.count(i) / norm for i in range(64)]) and set(rows[1]["embedding"]) == set(rows[2]["embedding"]) == {0.0}


def test_questions_settings_and_registries(spark, caplog):
    now = datetime(2026, 8, 14, 12, tzinfo=timezone.utc)
    assert evaluate.time_range_of("failures in the last 24h", now) == ("2026-08-13T12:00:00Z", "2026-08-14T12:00:00Z")
    assert evaluate.time_range_of("what happened yesterday", now) == ("2026-08-13T00:00:00Z", "2026-08-13T23:59:59Z") and evaluate.time_range_of("on 2026-02-30", now) is None
    assert evaluate.time_range_of("on 2026-08-01?", now)[0] == "2026-08-01T00:00:00Z" and evaluate.time_range_of("ever", now) is None
    assert (evaluate.route("How many logins failed?"), evaluate.route("did anyone escalate privileges")) == ("exact", "retrieve")
    s = settings.from_env({"CHUNK_GAP_MINUTES": "30", "RETRIEVE_TOP_K": "many", "RERANK_ENABLED": "off", "INDEX_RESUME": "?", "RERANK_BACKEND": "flashrank"})
    assert (s.gap_minutes, s.top_k, s.rerank_enabled, s.index_resume, s.rerank_backend) == (30, 5, False, True, "flashrank")
    assert models.repository("ms-marco-MiniLM-L-6-v2") == models.repository("") == models.DEFAULT_RERANKER and models.repository("a/B") == "a/B" and models.repository("x") == "x"
    assert [models.reranker("q", s), models.reranker("q", s, enabled=True, backend="none"), models.reranker("q", s, enabled=True, backend="unknown"), models.reranker("q", s, enabled=True)] == [None] * 4
    assert models.embedder(s, "hashed") is ingest.hashed_embedding and models.dimension("BAAI/bge-small-en-v1.5") == 384
    for bad in (lambda: models.embedder(s, "unknown"), lambda: models.dimension("unknown")):
        with pytest.raises(ValueError):
            bad()
    hits = spark.createDataFrame([("w1", 1, "aa"), ("w2", 2, "a" * 9000), ("w3", 3, "b")], "id string, rank int, text string")
    scorer = models.scored_by("q", lambda: lambda question, texts: [float(len(t)) for t in texts])
    got = retrieval.rerank(hits, "id", scorer, top_n=2).orderBy("rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [("w2", 4000.0), ("w1", 2.0), ("w3", None)] and [(r["id"], r["rerank_score"]) for r in retrieval.rerank(hits, "id", top_n=2).collect()] == [("w1", 0.0), ("w2", 0.0)]
    vectors = models.encoded_by(lambda: lambda texts: [[len(t), 1.0] for t in texts])(hits).collect()
    assert vectors[0]["embedding"] == [2.0, 1.0]
    assert [fields.format_eta(x) for x in (42, 185, 7620)] == ["42s", "3m 05s", "2h 07m"]
    record = settings.logging.makeLogRecord({"msg": "hi %s", "args": ("x",), "name": "n", "levelname": "INFO", "extra_fact": 3})
    assert json.loads(settings.JsonLines().format(record))["extra_fact"] == 3 and settings.setup_logging().handlers[0].formatter.__class__ is settings.JsonLines


def test_answers_are_rendered():
    hit = {"chunk_id": "w-00001", "rank": 1, "score": 0.0327868852, "dense_rank": 2, "bm25_rank": None, "rerank_score": None, "ts_start": "a", "ts_end": "b", "source": "auth", "principal": "", "src_ip": "1.1.1.1",
           "n_events": 2, "n_failures": 1, "risk_score": 3, "event_names": ["x"], "event_ids": ["e1", "e2"], "text": "t" * 50, "events": ["one", "two"]}
    d = render.answer("q", [hit], {"n": 1}, text_chars=10)["hits"][0]
    assert (d["score"], d["found_by"], d["rerank_score"], d["text"]) == (0.032787, ["dense"], None, "t" * 10 + render.CUT)
    assert render.prompt([hit, hit]) == "t" * 50 + "\n\n" + "t" * 50 and render.prompt([hit], 5) == "ttttt\n...[window truncated]"
    lines = render.hit_lines(hit, 1)
    assert "[dense#2]" in lines[1] and lines[2:] == ["      one"] and "  -  1.1.1.1" in lines[0]
    assert len(render.ranked_lines("t", [{"principal": "p" * 80, "n": 5, "failures": 1}], "principal")[1].split()[1]) == 46


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
