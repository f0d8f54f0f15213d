"""Tables of questions against one question at a time, and ordered steps against a walk over each key's events."""

import random

import pytest

from pyspark.sql import functions as F

from logloom.functions import fields
from logloom.operators import evaluate, inverted_index, retrieval


def test_many_questions_are_single_ones(spark, monkeypatch):
    monkeypatch.setattr(inverted_index, "SLICE", 2)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(draw.choices(words, k=draw.randrange(0, 40)))) for i in range(120)] + [("null", None), ("same1", "w1 w2"), ("same2", "w1 w2")], "id string, text string")
    asked = [(1, "w1 w2"), (2, "the the w5"), (3, "nowhere"), (4, ""), (5, None), (6, "w7 w8 w9 w10")]
    hits = inverted_index.search_all(docs, "id", spark.createDataFrame(asked, "question long, text string"), k=7).collect()
    for number, text in asked:
        got = sorted((r["rank"], r["key"], r["score"]) for r in hits if r["question"] == number)
        want = sorted((r["rank"], r["id"], r["score"]) for r in retrieval.bm25(docs, "id", text, 7).collect()) if text else []
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))
    few = spark.createDataFrame([(1, "w1"), (1, "w1 w2")], "question long, text string")
    with pytest.raises(ValueError):
        inverted_index.search_all(docs, "id", few)
    assert inverted_index.search_all(docs.limit(0), "id", few).count() == 0


def test_metrics_of_many_questions(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "a", 3)], "question long, key string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "b"), (1, "z"), (2, "c"), (3, "a")], "question long, key string")
    row = evaluate.recall_mrr_all(hits, truth, (1, 3)).first()
    assert row.asDict() == {"questions": 3, "recall_1": round(1 / 3, 6), "recall_3": round(1.5 / 3, 6), "mrr": round(1.5 / 3, 6)}


def walk(rows, actions, minutes, resets):
    out, state = set(), {}
    for key, number, second, action in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        begun = state.setdefault(key, [None] * len(actions))
        if action in resets:
            state[key] = [None] * len(actions)
            continue
        own = [second if action == actions[0] else None] + [b if action == a else None for a, b in zip(actions[1:], begun)]
        if own[-1] is not None and second - own[-1] <= minutes * 60:
            out.add((key, number, own[-1]))
        for i, x in enumerate(own):
            if x is not None:
                begun[i] = x if begun[i] is None else max(x, begun[i])
    return out


@pytest.mark.parametrize("actions, minutes", [(["a", "b", "c"], 30), (["a", "b"], 3000), (["a", "a"], 60), (["a"], 5)])
def test_steps_in_order(spark, actions, minutes):
    draw = random.Random(len(actions) + minutes)
    rows = [(draw.choice(["hot", "hot", "k1", "k2"]), f"e{i:04d}", draw.randrange(0, 4 * 86400 // 60) * 60, draw.choice("abcxr")) for i in range(1500)]
    frame = spark.createDataFrame(rows, "who string, event_id string, s long, action string").selectExpr("who", "event_id", "date_format(timestamp_seconds(s + 1704067200), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts", "action")
    got = {(r.who, r.event_id, r.began - 1704067200) for r in evaluate.steps_in_order(frame, ["who"], actions, minutes, ["r"]).collect()}
    want = walk(rows, actions, minutes, ["r"])
    assert got == want and want
    assert evaluate.steps_in_order(frame.limit(0), ["who"], actions, minutes).count() == 0


def test_counts_within_minutes_are_sums_of_steps(spark):
    """Held to plain counts; the plan has no frame over a range of time, whose cost grew with the square of a key's events."""
    draw = random.Random(11)
    rows = [(draw.choice(["hot", "hot", "k", None]), draw.choice(["a", "b", "c", "d", None]), draw.choice([None] + [draw.randrange(0, 3 * 86400) // 50 * 50] * 30)) for _ in range(1200)]
    frame = spark.createDataFrame(rows, "principal string, v string, s long").selectExpr("principal", "v", "date_format(timestamp_seconds(s + 1704067200), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as ts")
    stamp = dict(frame.selectExpr("ts", "unix_timestamp(to_timestamp(ts)) - 1704067200").distinct().collect())
    at = {s: ts for ts, s in stamp.items()}
    for minutes in (7, 300, 2000):
        inside = lambda k, s: [v for key, v, t in rows if key == k and (t is None if s is None else t is not None and s - minutes * 60 <= t <= s)]
        events = {(k, s): inside(k, s) for k, _, s in rows}
        for least in (2, 3, 4, 9):
            first = lambda size: {k: at[min(s for (key, s), vs in events.items() if key == k and s is not None and size(vs) >= least)] for k in ("hot", "k", None)
                                  if any(key == k and s is not None and size(vs) >= least for (key, s), vs in events.items())}
            assert dict(evaluate.different_within(frame, ["principal"], "v", minutes, least).collect()) == first(lambda vs: len(set(vs) - {None}))
            assert dict(evaluate.many_within(frame, ["principal"], minutes, least).collect()) == first(len)
        most = {k: max(len(vs) for (key, _), vs in events.items() if key == k) for k in ("hot", "k", None)}
        assert dict(evaluate.bursts(frame, minutes, 2).collect()) == most
    plan = evaluate.different_within(frame, ["principal"], "v", 7, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "collect_set" not in plan


def test_metrics_by_label_build_no_pairs(spark):
    """Held to the metrics over all pairs; the pairs, as many as items times questions, are not made."""
    draw = random.Random(5)
    items = spark.createDataFrame([(i, draw.choice([1, 2, 2, None])) for i in range(60)] + [(99, 7)], "key int, label int")
    asked = items.filter("key % 10 = 0 or key = 99").withColumnRenamed("key", "question")
    hits = spark.createDataFrame([(q, key, rank + 1) for q in (*range(0, 60, 10), 99) for rank, key in enumerate([q] + draw.sample(range(60), 8))], "question int, key int, rank int")
    truth = items.join(asked, "label").filter("key <> question")
    assert evaluate.recall_mrr_labels(hits, items, asked, (1, 5)).collect() == evaluate.recall_mrr_all(hits, truth, (1, 5)).collect()


def test_terms_of_tasks_are_those_of_columns(spark):
    """The counting tasks see what ``fields.tokenize`` gives; no plan takes texts apart token by token, nor moves a row a term."""
    odd = ["", None, "HTTPServer2 getURLs x", "10.0.0.1 1.2.3.4.5 10.0.0.1.", "a-B_c:d/e@f+g. -lead _x9 A", "\u212a\u0130 Stra\u00dfe caf\u00e9Bar \u0416x\U0001f600y", "end. End. END.\nEND\r\nIamABC 9AbC", "A" * 200 + "bC" * 50, "x" * 100 + ".Y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, text string")
    for most in (None, 3):
        whole = {r.id: r.t for r in docs.select("id", fields.tokenize(F.col("text"), most).alias("t")).collect()}
        told = retrieval.Terms(most)
        assert all(told.of(None if t is None else t.encode()) == whole[i] for i, t in enumerate(odd))
        got = {(r.id, r.dl, r.term, r.tf) for r in retrieval.postings(docs, "id", max_tokens=most).filter("term is not null").collect()}
        assert got == {(i, len(t), x, t.count(x)) for i, t in whole.items() for x in t}
        counts = {r.term: (r.df, r.dl) for r in retrieval.term_counts(docs, max_tokens=most).collect()}
        assert counts == {None: (len(odd), sum(map(len, whole.values())))} | {x: (sum(x in t for t in whole.values()), None) for t in whole.values() for x in t}
    plan = retrieval.bm25(docs, "id", "end abc")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    twice = docs.union(docs.filter("id in (2, 6)")).union(docs.filter("id = 3").withColumn("id", F.lit(2)))
    want = {r.term: r.df for r in retrieval.postings(twice, "id").filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r.term: r.df for r in retrieval.frequencies(twice, "id").collect()} == want | {None: len(odd) + 3}
