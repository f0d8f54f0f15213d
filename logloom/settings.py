"""Settings from environment variables; a bad value falls back to the default."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, fields
from datetime import datetime, timezone

#: Names of variables.
NAMES = {
    "gap_minutes": "CHUNK_GAP_MINUTES", "max_chars": "CHUNK_MAX_CHARS", "max_events": "CHUNK_MAX_EVENTS", "top_k": "RETRIEVE_TOP_K", "pool": "CANDIDATE_POOL", "rrf_k": "RRF_K", "max_tokens": "BM25_MAX_TOKENS",
    "rerank_enabled": "RERANK_ENABLED", "rerank_backend": "RERANK_BACKEND", "rerank_model": "RERANK_MODEL", "rerank_top_n": "RERANK_TOP_N", "embedding_backend": "EMBEDDING_BACKEND",
    "embedding_model": "EMBEDDING_MODEL", "index_resume": "INDEX_RESUME"}
TRUE, FALSE = ["1", "true", "yes", "on"], ["0", "false", "no", "off"]


@dataclass(frozen=True)
class Settings:
    gap_minutes: int = 15
    max_chars: int = 4800
    max_events: int = 120
    top_k: int = 5
    pool: int = 50
    rrf_k: int = 60
    max_tokens: int = 512
    rerank_enabled: bool = True
    rerank_backend: str = "none"
    rerank_model: str = ""
    rerank_top_n: int = 50
    embedding_backend: str = "hashed"
    embedding_model: str = ""
    index_resume: bool = True


def from_env(env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ) if env is None else env
    given = {}
    for f in fields(Settings):
        raw = env.get(NAMES[f.name], "").strip()
        if not raw:
            continue
        if isinstance(f.default, bool):
            if raw.lower() in TRUE + FALSE:
                given[f.name] = raw.lower() in TRUE
        elif isinstance(f.default, int):
            if raw.lstrip("-").isdigit():
                given[f.name] = int(raw)
        else:
            given[f.name] = raw
    return Settings(**given)


class JsonLines(logging.Formatter):
    """A log record as one line of JSON: time, level, logger, message, and what was given as ``extra``."""

    PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": datetime.fromtimestamp(record.created, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in self.PLAIN}
        if record.exc_info:
            out["exc"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def setup_logging(level: str = "INFO", as_json: bool = True) -> logging.Logger:
    """The library's logger with one handler, however often this is called."""
    log = logging.getLogger("logloom")
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(levelname)s %(name)s %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(getattr(logging, level.upper(), logging.INFO))
    return log
