"""Column expressions over events: status, ids, rendering, tokens. All run in the JVM."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status words, and parts of a message that mean failure.
SUCCESS = ["success", "succeeded", "ok", "accepted"]
FAILURE = ["failure", "failed", "error"]
FAILURE_HINTS = [
    "fail", "denied", "deny", "error", "invalid", "unauthorized", "refused", "timeout", "locked", "not authorized",
    "no such", "killed", "out of memory", "oom-kill", "segfault", "panic", "critical", "unable to",
]

#: Risk weights of actions.
RISK_WEIGHTS = {
    "StopLogging": 40, "DeleteTrail": 40, "UpdateTrail": 30, "PutEventSelectors": 30, "CreateUser": 20, "DeleteUser": 25,
    "CreateLoginProfile": 30, "UpdateLoginProfile": 25, "AttachUserPolicy": 35, "AttachRolePolicy": 35, "PutUserPolicy": 30,
    "PutRolePolicy": 30, "AddUserToGroup": 25, "CreateAccessKey": 30, "CreatePolicyVersion": 30, "AssumeRole": 10,
    "PutBucketPolicy": 30, "PutBucketAcl": 25, "DeleteBucketPolicy": 20, "PutBucketPublicAccessBlock": 15,
    "AuthorizeSecurityGroupIngress": 30, "AuthorizeSecurityGroupEgress": 25, "ModifySecurityGroupRules": 25,
    "GetSecretValue": 25, "DeleteDBInstance": 30, "CreateFunction": 20, "UpdateFunctionCode": 25,
}

#: Shapes of tokens, of their parts, and of addresses, which are not taken apart.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.:\-/@+]*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
SEPARATORS = r"[._:\-/@+]+"
IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_status(value: Column) -> Column:
    v = F.lower(F.trim(blank(value)))
    return F.when(v.isin(SUCCESS), "success").when(v.isin(FAILURE) | v.rlike("|".join(FAILURE_HINTS)), "failure").otherwise("info")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def is_root(principal: Column) -> Column:
    return principal.contains(":root") | principal.contains("/root")


def render_line(e: dict[str, Column]) -> Column:
    """One event as a line of seven fields, the last its id, by which answers cite it."""
    mark = F.when(e["status"] == "success", "OK").when(e["status"] == "failure", "FAIL").otherwise("INFO")
    dash = lambda c: F.when(blank(c) == "", "-").otherwise(c)
    return F.concat_ws(" | ", e["ts"], dash(e["action"]), mark, *(dash(e[c]) for c in ("principal", "src_ip", "region")), e["event_id"])


def valid_event(source_names: list[str]) -> Column:
    return (F.col("event_id") != "") & F.col("source").isin(source_names) & F.col("status").isin("success", "failure", "info") & parse_iso(F.col("ts")).isNotNull()


def tokenize(text: Column, most: int | None = None) -> Column:
    """Terms of a log line: each token in lower case, then its camel-case parts and its parts between separators.

    ``most`` keeps the first terms; as each token gives at least one, no more tokens than that are taken apart.
    """
    def terms(raw: Column) -> Column:
        low = F.lower(raw)
        parts = lambda a: F.filter(F.transform(a, F.lower), lambda p: (F.length(p) >= 2) & (p != low))
        camel, split = parts(F.regexp_extract_all(raw, F.lit(CAMEL), F.lit(0))), parts(F.split(raw, SEPARATORS))
        return F.when(raw.rlike("^[a-z0-9]+$"), F.array(raw)).when(raw.rlike(IPV4), F.array(low)).otherwise(F.concat(
            F.array(low), F.when(raw.rlike("[A-Z]"), camel).otherwise(F.array().cast("array<string>")), split))
    raw = F.regexp_extract_all(blank(text), F.lit(TOKEN), F.lit(0))
    if most is None:
        return F.flatten(F.transform(raw, terms))
    return F.slice(F.flatten(F.transform(F.slice(raw, 1, most), terms)), 1, most)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…[truncated]"))).otherwise(text)


def format_eta(seconds: float) -> str:
    """A span as "42s", "3m 05s" or "2h 07m"."""
    s = max(0, int(seconds))
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60:02d}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60:02d}m"
