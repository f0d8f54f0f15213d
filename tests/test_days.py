"""Tables kept by day: merges against plain upserts, what they rewrite, and runs that die on the way."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import shared
from logloom.operators import days, tables

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "ts", "action")])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, path):
    return {r.event_id: (r.ts, r.action) for r in days.read(spark, path, SCHEMA).collect()}


def base(spark, path, n=400):
    rows = [(f"e{i}", f"2024-01-{1 + i % 20:02d}T00:{i % 60:02d}:00Z", "old") for i in range(n)]
    days.merge(spark, path, frame(spark, rows), "event_id")
    return {r[0]: r[1:] for r in rows}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_merge_rewrites_the_changed_days_only(spark, tmp_path):
    path = tmp_path / "events"
    want, before = base(spark, str(path)), files(path)
    fresh = [("e3", "2024-01-04T09:00:00Z", "new"), ("e24", "2024-01-09T00:00:00Z", "moved"), ("x", "2024-02-01T00:00:00Z", "new"), ("n", None, "new")]
    report = days.merge(spark, str(path), frame(spark, fresh), "event_id")
    want |= {r[0]: r[1:] for r in fresh}
    assert rows_of(spark, str(path)) == want and days.read(spark, str(path), SCHEMA).count() == len(want)
    assert report == {"days": 22, "days_rewritten": 5}  # the 4th, the 5th that e24 left, the 9th, one new day, none
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[0] for f in before} - {f.split("/")[0] for f in same} == {f"day=2024-01-{d:02d}" for d in (4, 5, 9)}
    assert not (tmp_path / "events_changed").exists()


def test_days_that_lose_all_rows_and_empty_merges(spark, tmp_path):
    path = str(tmp_path / "events")
    days.merge(spark, path, frame(spark, []), "event_id")
    assert rows_of(spark, path) == {}
    days.merge(spark, path, frame(spark, [("a", "2024-01-01T00:00:00Z", "x")]), "event_id")
    days.merge(spark, path, frame(spark, [("a", "2024-01-02T00:00:00Z", "y")]), "event_id")
    days.merge(spark, path, frame(spark, []), "event_id")
    assert rows_of(spark, path) == {"a": ("2024-01-02T00:00:00Z", "y")}
    assert [p.name for p in (tmp_path / "events").glob("day=*")] == ["day=2024-01-02"]


@pytest.mark.parametrize("dies_at", ["staging", "switch"])
def test_a_merge_that_dies(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "events")
    want, fresh, real, calls = base(spark, path), [("e1", "2024-01-03T00:00:00Z", "new")], days.write, []

    def fails(rows, where, changed_only=False):
        calls.append(where)
        if (dies_at == "staging") != changed_only:
            raise OSError("lost")
        real(rows, where, changed_only)
    monkeypatch.setattr(days, "write", fails)
    with pytest.raises(OSError):
        days.merge(spark, path, frame(spark, fresh), "event_id")
    monkeypatch.setattr(days, "write", real)
    assert rows_of(spark, path) == want
    days.recover(spark, path, SCHEMA)
    done = want | {r[0]: r[1:] for r in fresh}
    assert rows_of(spark, path) == (want if dies_at == "staging" else done) and not shared.exists(spark, path + "_changed")
    days.merge(spark, path, frame(spark, fresh), "event_id")
    assert rows_of(spark, path) == done


def test_ranges_read_their_days_only_and_ids_come_from_a_table(spark, tmp_path):
    path = str(tmp_path / "events")
    want = base(spark, path)
    stored = days.read(spark, path, SCHEMA)
    few = tables.between(stored, "2024-01-05", "2024-01-06T12:00:00Z")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {r.event_id for r in few.collect()} == {k for k, v in want.items() if "2024-01-05" <= v[0] <= "2024-01-06T12:00:00Z"}
    ids = spark.range(0, 100_000).select(F.concat(F.lit("e"), F.col("id") * 3).alias("event_id"), F.lit(1).alias("ts"))
    assert {r.event_id for r in tables.by_ids(stored, "event_id", ids).collect()} == {k for k in want if int(k[1:]) % 3 == 0}
