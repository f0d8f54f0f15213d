"""Windows brought up to new events against a full build, what is built anew, runs that die, and the index beside them."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom import shared
from logloom.operators import days, windows
from logloom.plans import ingest
from logloom.schemas import EVENT

RULES = (15, 500, 4)


def event(i, at, principal="p", action="a"):
    ts = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(at, int) else at
    return (f"e{i}", ts, "auth", action, "info", principal, "", "", "", "", "", "", "", "")


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def start(spark, out, rows):
    days.merge(spark, f"{out}/events", frame(spark, rows), "event_id")
    ingest.build_all(spark, out, *RULES, True)
    ingest.set_meta(spark, out, window_rules=",".join(map(str, RULES)), schema_version=ingest.SCHEMA_VERSION)
    return {r[0]: r for r in rows}


def holds(spark, out, rows):
    """The store's windows and bridge are those of a full build."""
    want = windows.build_windows(frame(spark, list(rows.values())), *RULES, by_content=True)
    got = days.read(spark, f"{out}/windows", ingest.STORED_WINDOW).drop("day").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    bridge = spark.read.parquet(f"{out}/window_events").select("chunk_id", "event_id", "position")
    assert sorted(map(tuple, bridge.collect())) == sorted(map(tuple, windows.membership(want).collect()))
    return {r.chunk_id for r in got.collect()}


def test_updates_equal_a_full_build(spark, tmp_path):
    out, draw, t0 = str(tmp_path), random.Random(7), 1_704_060_000
    rows, at = [], t0
    for i in range(300):
        at += draw.choice([0, 0, 1, 300, 899, 900, 901, 5000, 90_000])
        rows.append(event(i, at, draw.choice("ppq"), draw.choice("ab") * draw.randint(1, 30)))
    rows += [event(300, "", "q"), event(301, "no time", "r"), event(302, t0, "r"), event(303, "", "s")]
    state = start(spark, out, rows)
    holds(spark, out, state)
    for batch in range(2):
        fresh = {}
        for _ in range(draw.randint(3, 12)):
            i, place = draw.choice([draw.randrange(304), draw.randint(400, 480)]), draw.choice(rows)[1]
            when = int(datetime.fromisoformat(place).timestamp()) + draw.choice([-901, -900, -1, 0, 1, 450, 900, 901]) if len(place) == 20 else place
            fresh[f"e{i}"] = event(i, when, draw.choice("pqrt"), "c" * draw.randint(1, 30))
        ingest.advance(spark, out, frame(spark, list(fresh.values())), *RULES)
        state |= fresh
        holds(spark, out, state)
    report = ingest.advance(spark, out, frame(spark, []), *RULES)
    assert report["windows_rebuilt"] == report["window_days_rewritten"] == 0
    holds(spark, out, state)


def test_an_endless_session_costs_its_end_and_others_stay(spark, tmp_path):
    out, t0 = str(tmp_path), 1_704_060_000
    rows = [event(i, t0 + 600 * i) for i in range(600)] + [event(1000 + i, t0 + 86_400 * (i % 4), f"o{i}") for i in range(40)]
    state = start(spark, out, rows)
    before, files = holds(spark, out, state), {p: p.stat().st_mtime_ns for p in (tmp_path / "windows").rglob("*.parquet")}
    new = [event(2000, t0 + 600 * 600)]
    report = ingest.advance(spark, out, frame(spark, new), *RULES)
    after = holds(spark, out, state | {r[0]: r for r in new})
    assert report["windows_rebuilt"] <= 2 and len(before - after) <= 1 and len(after - before) <= 2
    assert report["window_days_rewritten"] == 1 and sum(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items()) >= len(files) - 1
    starts = {r[0] for r in days.read(spark, f"{out}/windows", ingest.STORED_WINDOW).filter("principal = 'p'").select("session_start").collect()}
    assert starts == {rows[0][1]}


@pytest.mark.parametrize("dies_at", ["merge", "replace", "put_bridge"])
def test_a_run_that_dies(spark, tmp_path, monkeypatch, dies_at):
    out, t0 = str(tmp_path), 1_704_060_000
    state = start(spark, out, [event(i, t0 + 400 * i, "pq"[i % 2]) for i in range(40)])
    new = [event(3, t0 + 90_000, "q"), event(50, t0 + 1, "p")]

    def fails(*args, **more):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(ingest if dies_at == "put_bridge" else days, dies_at, fails)
        with pytest.raises(OSError):
            ingest.advance(spark, out, frame(spark, new), *RULES)
    again, later = ([], new) if dies_at == "put_bridge" else (new, new)
    ingest.advance(spark, out, frame(spark, again), *RULES)
    holds(spark, out, state | {r[0]: r for r in later})
    assert not shared.exists(spark, f"{out}/_touched")


def test_index_embeds_what_changed(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    line = "Aug {:2d} 0{}:11:03 h sshd[1]: Failed password for bob{} from 9.9.9.9 port 22 ssh2\n"
    (raw / "auth.log").write_text("".join(line.format(d, h, h) for d in range(1, 9) for h in range(1, 6)))
    run = lambda: ingest.ingest(spark, str(raw), out, 2026, stable_ids=True)
    assert run()["windows"] == 40 and ingest.index(spark, out, ingest.hashed_embedding)["embedded"] == 40
    old = {r.chunk_id for r in ingest.stored_windows(spark, out).collect()}
    (raw / "more").mkdir()
    (raw / "more" / "auth.log").write_text(line.format(3, 1, 1).replace(":11:", ":15:") + line.format(20, 1, 9))
    report = run()
    assert report["events"] == 42 and report["windows"] == 41 and report["windows_changed"] == 2
    new = {r.chunk_id for r in ingest.stored_windows(spark, out).collect()}
    assert len(new - old) == 2 and len(old - new) == 1
    health = ingest.index_health(spark, out)
    assert (health["missing"], health["stale"]) == (2, 1)
    done = ingest.index(spark, out, ingest.hashed_embedding)
    assert (done["embedded"], done["skipped_existing"], done["vectors"]) == (2, 39, 41) and ingest.index_health(spark, out)["healthy"]
    numbered = ingest.ingest(spark, str(raw), out, 2026)
    assert numbered["windows"] == 41 and ingest.stored_windows(spark, out).filter(F.col("chunk_id") == "w-00041").count() == 1
    assert ingest.index(spark, out, ingest.hashed_embedding)["embedded"] == 41 and ingest.index_health(spark, out)["healthy"]
