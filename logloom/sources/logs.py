"""Cloud audit JSON and syslog text files as event rows."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import blank, iso_utc, normalize_status, stable_id
from ..schemas import EVENT
from .arrays import array_files, elements

#: File names by family, and JSON artefacts that are not logs.
JSON_SUFFIXES, TEXT_SUFFIXES = ["json", "jsonl", "ndjson"], ["log", "txt", "out"]
TEXT_NAMES = ["syslog", "auth", "messages", "secure", "sshd", "daemon", "kern", "user"]
NOT_LOGS = ["manifest", "labels", "eval_set", "eval-set", "index", "stats", "config"]
AUTH_HINTS = ["auth", "ssh", "secure"]
#: Keys of a manifest that hold a date, the last as the generator here writes it.
MANIFEST_DATES = ["corpus_now", "end_date", "end", "generated_at", "corpus_end_date"]
#: Request keys that name a resource, in order of preference.
RESOURCE_KEYS = ["bucketName", "bucket", "userName", "groupName", "roleName", "policyName", "trailName", "instanceId", "functionName",
                 "queueUrl", "topicArn", "secretId", "keyId", "dbInstanceIdentifier"]
#: Line shapes.
PREFIX = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([A-Za-z0-9_.\-]+)(?:\[(\d+)\])?:\s*(.*)$"
FAILED = r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)"
ACCEPTED = r"Accepted (password|publickey) for (\S+) from (\S+) port (\d+)"
INVALID = r"Invalid user (\S+) from (\S+)"
SUDO = r"(\S+)\s*:\s*.*?COMMAND=(.*)$"
CRON = r"\((\S+)\) CMD \((.*)\)"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def is_log_file(name: Column) -> Column:
    low = F.lower(name)
    stem = F.regexp_replace(low, r"(?<=.)\.[^.]*$", "")
    return ~low.startswith(".") & F.when(_suffix(low).isin(JSON_SUFFIXES), ~stem.isin(NOT_LOGS)).otherwise(_suffix(low).isin(TEXT_SUFFIXES) | low.isin(TEXT_NAMES))


def detect_source(name: Column) -> Column:
    low = F.lower(name)
    text = _suffix(low).isin(TEXT_SUFFIXES) | low.rlike("^(auth|syslog|ssh)")
    return F.when(_suffix(low).isin(JSON_SUFFIXES) | low.contains("cloudtrail"), "cloudtrail").when(text, "syslog").otherwise("cloudtrail")


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """Log files below the folders of ``paths``, sorted by path, in the order of ``paths``; files named there always stay.

    Only the listing is read; it is as long as the one that every scan of files holds. Paths that aren't there give none.
    """
    found: list[tuple[int, str, bool]] = []
    for k, path in enumerate(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            continue
        if files.getFileStatus(place).isFile():
            found.append((k, files.getFileStatus(place).getPath().toString(), True))
            continue
        below = files.listFiles(place, True)
        while below.hasNext():
            found.append((k, below.next().getPath().toString(), False))
    if not found:
        return []
    rows = spark.createDataFrame(found, "k int, file string, named boolean").filter(F.col("named") | is_log_file(F.element_at(F.split("file", "/"), -1))).orderBy("k", "file")
    return list(dict.fromkeys(r["file"] for r in rows.collect()))


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, name, block, at, i, line``: lines with their number in the file, from 1, however the files are split.

    Rows of a block of a file are read in order, so a line's number is its place in the block plus the lines of the
    blocks before; those counts are one row a block.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text(files).select(*meta, F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select("file", name_of("file"), "block", "at", (F.col("at") + F.col("shift")).alias("i"), "line")


def name_of(column: str) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(column, "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name")


def json_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``name, file, i, record``: records of JSON arrays and JSON lines.

    ``i`` counts the records of a file that are JSON, from 1; malformed lines and arrays have none. Lines are read as
    lines, whatever a file's size; a file whose first mark is a bracket is one array, which many tasks read, too (``arrays``).
    """
    if not files:
        return spark.createDataFrame([], "name string, file string, i long, record string")
    # As many rows as files at most, which the scan lists anyway.
    arrays = {unquote(r["file"]) for r in array_files(spark, files).collect()}
    plain = [f for f in files if f not in arrays]
    rest = numbered_lines(spark, plain) if plain else spark.createDataFrame([], "file string, name string, block long, at long, i long, line string")
    rest = rest.filter(F.trim("line") != "").withColumn("ok", F.try_parse_json("line").isNotNull().cast("int"))
    known = rest.groupBy("file", "block").agg(F.sum("ok").alias("n"))
    before = known.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("ok").over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rest.withColumn("own", own).join(before, ["file", "block"]).select(
        "name", "file", F.when(F.col("ok") == 1, F.col("before") + F.col("own")).alias("i"), F.trim("line").alias("record"))
    if arrays:
        out = out.unionByName(elements(spark, sorted(arrays)).select(name_of("file"), "file", "i", "record"))
    return out


def cloudtrail_events(records: DataFrame) -> DataFrame:
    """Events of ``json_records``, with ``parse_ok`` false for records that hold none."""
    rows = records.select("file", "name", "i", "record", F.try_parse_json("record").alias("v"))

    def get(path: str) -> Column:
        return blank(F.try_variant_get("v", "$." + path, "string"))
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    account = get("userIdentity.accountId")
    principal = first(get("userIdentity.arn"), F.when(get("userIdentity.userName") != "", F.concat(F.lit("arn:aws:iam::"), account, F.lit(":user/"), get("userIdentity.userName"))), get("userIdentity.principalId"))
    resource = []
    for payload in ("requestParameters", "responseElements"):
        resource += [F.when(get(f"{payload}.{k}") != "", F.concat(F.lit(k + "="), get(f"{payload}.{k}"))) for k in RESOURCE_KEYS]
        resource.append(F.when((get(f"{payload}.groupId") != "") & get("eventName").rlike("^(Authorize|Revoke|Modify)"), F.concat(F.lit("securityGroup="), get(f"{payload}.groupId"))))
    said = F.regexp_replace(get("eventTime"), r"\+00:00$", "Z")
    # Times of other offsets are written as UTC, so that their order as text is their order in time.
    ts = F.when(said.rlike(r"[+-][0-9]{2}:?[0-9]{2}$") & said.contains("T"), F.coalesce(iso_utc(F.try_to_timestamp(said)), said)).otherwise(said)
    given = F.trim(get("eventID"))
    made_up = stable_id("ct", ts, get("eventName"), principal, get("sourceIPAddress"))
    extra = F.to_json(F.struct(get("eventSource").alias("event_source"), first(get("errorCode"), get("errorMessage")).alias("error_code"), get("userIdentity.type").alias("identity_type"), F.coalesce(F.try_variant_get("v", "$.readOnly", "boolean"), F.lit(False)).alias("read_only")))
    return rows.select(
        F.when(given != "", F.concat(F.lit("ct-"), given)).otherwise(made_up).alias("event_id"), ts.alias("ts"), F.lit("cloudtrail").alias("source"),
        get("eventName").alias("action"), F.when(get("errorCode") != "", "failure").otherwise("success").alias("status"), principal.alias("principal"),
        get("sourceIPAddress").alias("src_ip"), get("awsRegion").alias("region"), first(account, get("recipientAccountId")).alias("account_id"),
        F.coalesce(*resource, F.lit("")).alias("resource"), get("userAgent").alias("user_agent"), blank(F.col("record")).alias("raw"),
        F.concat_ws(":", "name", F.col("i").cast("string")).alias("raw_ref"), extra.alias("extra"), "file", F.col("i").alias("place"), F.col("i").isNotNull().alias("is_record"),
        ((get("eventTime") != "") & (get("eventName") != "") & F.try_to_timestamp(ts).isNotNull()).alias("parse_ok"))


def syslog_events(lines: DataFrame, year: int) -> DataFrame:
    """Events of ``numbered_lines`` by the first rule that fits, with ``parse_ok`` false for lines without the prefix or a real time."""
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    part = lambda k: F.regexp_extract("line", PREFIX, k)
    msg, proc = part(7), part(5)
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(1)), F.lit(0)), F.lit(1)).cast("int")
    clock = F.split(part(3), ":")
    n = lambda c: F.try_variant_get(F.try_parse_json(F.regexp_replace(c, "^0(?=.)", "")), "$", "int")
    ts = F.date_format(F.try_make_timestamp(F.lit(year), month, n(part(2)), n(F.get(clock, 0)), n(F.get(clock, 1)), n(F.get(clock, 2)).cast("decimal(8,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    x = lambda shape, k: F.regexp_extract(msg, shape, k)
    rules = [
        (msg.rlike(FAILED), F.lit("sshd.failed_password"), F.lit("failure"), x(FAILED, 1), x(FAILED, 2), F.lit("")),
        (msg.rlike(ACCEPTED), F.lit("sshd.accepted_password"), F.lit("success"), x(ACCEPTED, 2), x(ACCEPTED, 3), F.lit("")),
        (msg.rlike(INVALID), F.lit("sshd.invalid_user"), F.lit("failure"), x(INVALID, 1), x(INVALID, 2), F.lit("")),
        (msg.contains("session opened"), F.lit("sshd.session_opened"), F.lit("success"), F.lit(""), F.lit(""), F.lit("")),
        (msg.contains("session closed"), F.lit("sshd.session_closed"), F.lit("info"), F.lit(""), F.lit(""), F.lit("")),
        (msg.rlike(SUDO), F.lit("sudo.command"), F.lit("success"), x(SUDO, 1), F.lit(""), F.substring(x(SUDO, 2), 1, 160)),
        (msg.rlike(CRON), F.lit("cron.job"), F.lit("info"), x(CRON, 1), F.lit(""), F.substring(x(CRON, 2), 1, 160)),
        (proc == "kernel", F.lit("kernel.message"), normalize_status(msg), F.lit(""), F.lit(""), F.lit("")),
        (proc.contains("systemd"), F.lit("systemd.unit"), normalize_status(msg), F.lit(""), F.lit(""), F.lit("")),
    ]

    def pick(k: int, otherwise: Column) -> Column:
        out = F.when(rules[0][0], rules[0][k])
        for rule in rules[1:]:
            out = out.when(rule[0], rule[k])
        return out.otherwise(otherwise)
    low = F.lower("name")
    family = F.when(low.rlike("|".join(AUTH_HINTS)), "auth").otherwise("syslog")
    ref = F.concat_ws(":", "name", F.col("i").cast("string"))
    extra = F.to_json(F.struct(part(4).alias("host"), part(6).alias("pid"), proc.alias("process")))
    return lines.select(
        stable_id("sl", ref, F.col("line")).alias("event_id"), blank(ts).alias("ts"), family.alias("source"), pick(1, F.concat(proc, F.lit(".message"))).alias("action"),
        pick(2, F.lit("info")).alias("status"), pick(3, F.lit("")).alias("principal"), pick(4, F.lit("")).alias("src_ip"), F.lit("").alias("region"), F.lit("").alias("account_id"),
        pick(5, F.lit("")).alias("resource"), F.lit("").alias("user_agent"), F.col("line").alias("raw"), ref.alias("raw_ref"), extra.alias("extra"), "file", F.col("i").alias("place"), F.lit(True).alias("is_record"),
        (F.col("line").rlike(PREFIX) & ts.isNotNull()).alias("parse_ok"))


class Counters:
    """Files, records and skipped records of a load, known once its rows have been read by an action."""

    def __init__(self, files: int, seen: Observation | None):
        self.files, self.seen = files, seen

    def get(self) -> dict:
        return {"files": self.files} | (dict(self.seen.get) if self.seen else {"records": 0, "skipped": 0})


def load_events(spark: SparkSession, paths: str | list[str], year: int) -> tuple[DataFrame, Counters]:
    """(events with ``file`` and ``place``, counters).

    ``records`` counts what was read as a record, usable or not; ``skipped`` what gave no event, malformed JSON included.
    The counts are taken while the events are read.
    """
    files = discover(spark, [paths] if isinstance(paths, str) else list(paths))
    if not files:
        return spark.createDataFrame([], EVENT).withColumns({"file": F.lit(""), "place": F.lit(0).cast("long")}), Counters(0, None)
    kinds = spark.createDataFrame([(f,) for f in files], "file string").select("file", detect_source(name_of("file")).alias("kind")).collect()
    of = lambda kind: [r["file"] for r in kinds if r["kind"] == kind]
    rows = cloudtrail_events(json_records(spark, of("cloudtrail")))
    if of("syslog"):
        rows = rows.unionByName(syslog_events(numbered_lines(spark, of("syslog")), year))
    seen = Observation()
    rows = rows.observe(seen, F.count_if("is_record").alias("records"), F.count_if(~F.col("parse_ok")).alias("skipped"))
    return rows.filter("parse_ok").select(*EVENT.fieldNames(), "file", "place"), Counters(len(files), seen)


def resolve_year(spark: SparkSession, paths: list[str], fallback: int | None = None) -> int:
    """The year that syslog lines lack: of a ``manifest.json`` in a folder of ``paths`` or above, else ``fallback`` or this one."""
    for path in paths:
        up = path.rstrip("/").rsplit("/", 1)[0]
        for place in (path.rstrip("/"), up, up.rsplit("/", 1)[0]):
            try:
                text = spark.read.text(f"{place}/manifest.json", wholetext=True).first()
                facts = json.loads(text[0]) if text else None
            except (AnalysisException, ValueError):
                continue
            for key in MANIFEST_DATES if isinstance(facts, dict) else ():
                if isinstance(facts.get(key), str) and facts[key][:4].isdigit() and len(facts[key]) >= 4:
                    return int(facts[key][:4])
    return fallback or datetime.now(timezone.utc).year
