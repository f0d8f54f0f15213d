import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import inverted_index, retrieval


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    inverted_index.write(docs, "doc_id", path, block=16)
    return path, docs


def rows_of(df, key="doc_id"):
    return [(r["rank"], r[key], r["score"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("question", ["the License version 2.0", "license", "the the of", "Licensed under the Apache License, Version 2.0 http://www.apache.org/licenses", "nothing-of-this-kind zzz", ""])
def test_top_k_is_that_of_all_texts(spark, stored, question):
    path, docs = stored
    for k in (1, 10, 300):
        assert rows_of(inverted_index.search(spark, path, question, k, key="doc_id")) == rows_of(retrieval.bm25(docs, "doc_id", question, k))


def test_a_question_reads_its_terms_alone(spark, stored):
    path, _ = stored
    rows = inverted_index.of_terms(spark, path, ["license"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert {r.term for r in rows.collect()} == {"license"} and len(rows.inputFiles()) >= 1
    files = spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("f"), "term").filter("term = 'license'").select("f").distinct().count()
    assert files <= 2


def test_blocks_that_cannot_reach_are_left_out(spark, tmp_path, monkeypatch):
    """One document in a hundred fits well; the others hold the common word alone, and most blocks are not scored."""
    docs = spark.createDataFrame([(i, "common needle needle" if i % 97 == 0 else "common " + "filler " * (i % 9 + 1)) for i in range(3000)], "id long, text string")
    inverted_index.write(docs, "id", str(tmp_path), block=30)
    seen = []
    monkeypatch.setattr(inverted_index, "ranked", lambda rows, key, k: (seen.append(rows.count()), retrieval.ranked(rows, key, k))[1])
    got = inverted_index.search(spark, str(tmp_path), "needle common", 5, key="id")
    assert rows_of(got, "id") == rows_of(retrieval.bm25(docs, "id", "needle common", 5), "id") and seen[0] < 2000


def test_edges(spark, tmp_path):
    draw = random.Random(1)
    rows = [("a", None, 1), ("b", "", 1), (None, "x needle", 1), ("c", "needle " * 600, 2)] + [(f"d{i}", " ".join(draw.choices(["x", "y", "needle", "ConsoleLogin"], k=i % 5)), i) for i in range(60)]
    docs = spark.createDataFrame(rows, "id string, text string, term int")
    inverted_index.write(docs, "id", str(tmp_path / "one"), block=7)
    for question in ("needle consolelogin", "x y"):
        got, want = (rows_of(f, "id") for f in (inverted_index.search(spark, str(tmp_path / "one"), question, 20, key="id"), retrieval.bm25(docs, "id", question, 20)))
        assert got == want
    assert inverted_index.search(spark, str(tmp_path / "one"), "x", 0, key="id").count() == 0
    inverted_index.write(docs, "id", str(tmp_path / "two"), max_tokens=5)
    assert rows_of(inverted_index.search(spark, str(tmp_path / "two"), "needle", 70, key="id"), "id") == rows_of(retrieval.bm25(docs, "id", "needle", 70, max_tokens=5), "id")
    inverted_index.write(docs.limit(0), "id", str(tmp_path / "none"))
    assert inverted_index.search(spark, str(tmp_path / "none"), "x", key="id").count() == 0


def test_texts_are_taken_apart_by_tasks(spark, tmp_path, monkeypatch):
    """Neither the index nor a table of questions splits texts by column expressions."""
    from logloom.operators import inverted_index
    docs = spark.createDataFrame([(1, "HTTPServer ran. end"), (2, None), (3, "the end")], "id long, text string")
    with monkeypatch.context() as m:
        m.setattr(inverted_index, "tokenize", None)
        inverted_index.write(docs, "id", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/stats").first()["n"] == 3
    held = {(r.term, e.key, e.tf, e.dl) for r in spark.read.parquet(f"{tmp_path}/postings").collect() for e in r.entries}
    assert held == {("httpserver", 1, 1, 6), ("http", 1, 1, 6), ("server", 1, 1, 6), ("ran.", 1, 1, 6), ("ran", 1, 1, 6), ("end", 1, 1, 6), ("the", 3, 1, 2), ("end", 3, 1, 2)}
    plan = inverted_index.search_all(docs, "id", spark.createDataFrame([(1, "end")], "question long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
