import json
import random

import pytest

from logloom.sources import arrays, logs

#: Each file's elements, or None where it is no array.
HARD = {
    "plain": '[{"a": 1}, {"b": {"c": [1, {"d": 2}]}}]', "strings": json.dumps([{"a": '}{"][', "b": 'x\\"}', '}"\\': "\\\\"}, "}", '"', {"k": "{"}], indent=2),
    "mixed": '[5, "x", {"a": 1}, null, [1, {"b": 2}], {"c": "}"} , true ]\n', "last": '[{"a": 1}, 5, [2]]', "empty": " [ ] ", "nested": '[[{"a": 1}, {"b": 2}], {"c": 3}]', "lines": '\n [\r\n{"a": "ü}"}\t,\n{"b": "日本"}\n]\n\n',
    "cut": '[{"a": 1}, {"b": 2}', "open": '[{"a": "x}]', "comma": '[{"a": 1},]', "two": '[{"a": 1} {"b": 2}]', "after": '[{"a": 1}] {"b": 2}', "bad": '[{"a": 1}, {"b": nope}, {"c": 3}]', "short": "[1, 2", "lead": '[,{"a": 1}]'}


def values(text):
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, list) else None


def read(spark, folder):
    out = {}
    for r in arrays.elements(spark, [str(folder)]).collect():
        own = out.setdefault(r.file.rsplit("/", 1)[-1].removesuffix(".json"), {})
        own[r.i] = r.record
    return out


def same(record, value):
    """Strings come as they are, all else as JSON."""
    return record == value if isinstance(value, str) else record is None if value is None else json.loads(record) == value


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_arrays_however_they_are_split(spark, tmp_path, block):
    for name, text in HARD.items():
        (tmp_path / f"{name}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in HARD.items():
        want = values(text)
        if want is None:
            assert got[name] == {None: None}, name
        elif want:
            assert sorted(got[name]) == list(range(1, len(want) + 1)) and all(same(got[name][i], v) for i, v in enumerate(want, 1)), name
        else:
            assert name not in got


def test_one_file_is_many_tasks(spark, tmp_path):
    draw = random.Random(3)
    rows = [{"eventID": str(i), "eventTime": "2026-01-01T00:00:00Z", "eventName": "A", "requestParameters": {"note": draw.choice(['}', '{"', "]", "\\", "x"]) * draw.randint(0, 9)}} for i in range(3000)]
    (tmp_path / "day.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        parts = arrays.fragments(spark, [str(tmp_path)]).select("block").distinct().count()
        events, counters = logs.load_events(spark, [str(tmp_path)], 2026)
        got = {r.event_id: r.raw_ref for r in events.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert parts > 10 and got == {f"ct-{i}": f"day.json:{i + 1}" for i in range(3000)} and counters.get() == {"files": 1, "records": 3000, "skipped": 0}
