import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import registry
from logloom.operators import vector_index


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    return path, vectors, vector_index.build(vectors, "vec_id", path)


def test_recall_and_what_is_read(spark, built):
    path, vectors, facts = built
    assert facts["vectors"] == vectors.count() and facts["clusters"] > 20
    questions = vectors.filter("vec_id % 100 = 0")
    found, true = vector_index.search(spark, path, questions, "vec_id"), vector_index.exact(vectors, questions, "vec_id")
    assert vector_index.recall_of(found, true).agg(F.avg("recall")).first()[0] >= 0.9
    exact = {(r.question, r.key): r.score for r in vector_index.exact(vectors, questions, "vec_id", k=2000).collect()}
    assert all(abs(exact[r.question, r.key] - r.score) < 2e-6 for r in found.collect())
    assert {r.question: r.key for r in found.filter("rank = 1").collect()} == {r.vec_id: r.vec_id for r in questions.collect()}
    # One question reads eight folders, and of them neither vectors nor what else there is.
    codes = vector_index.probed(spark, path, list(range(8))).select("cluster", "key", "code")
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan and "ReadSchema: struct<key:bigint,code:binary>" in plan
    assert codes.count() < facts["vectors"] / 2 and spark.read.parquet(f"{path}/codes").count() == facts["vectors"]


def test_more_probes_find_more(spark, built):
    path, vectors, facts = built
    questions = vectors.filter("vec_id % 100 = 0")
    true = vector_index.exact(vectors, questions, "vec_id", k=20)
    share = [vector_index.recall_of(vector_index.search(spark, path, questions, "vec_id", k=20, probes=p, again=20), true).agg(F.avg("recall")).first()[0] for p in (1, 4, facts["clusters"])]
    assert share[0] <= share[1] <= share[2] and share[2] > 0.99


def test_grouped_vectors_need_few_probes(spark, tmp_path):
    """Vectors in groups, as texts give them: at the recall asked for, a twentieth of the clusters is read."""
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.25 * draw.normal(size=24)).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    facts = vector_index.build(vectors, "id", str(tmp_path))
    questions = vectors.filter("id % 100 = 0")
    found, true = vector_index.search(spark, str(tmp_path), questions, "id"), vector_index.exact(vectors, questions, "id")
    assert facts["probes_95"] <= facts["clusters"] / 10 and vector_index.recall_of(found, true).agg(F.avg("recall")).first()[0] >= 0.9


def test_one_cluster_holds_most(spark, tmp_path):
    """A third of all vectors are equal: their cluster is several rows of several tasks, and all are found."""
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0] if i % 3 == 0 else draw.normal(size=5).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(6)
    vector_index.build(vectors, "id", str(tmp_path), parts=3)
    got = vector_index.search(spark, str(tmp_path), vectors.filter("id = 0"), "id", k=300).collect()
    assert sorted(r.key for r in got) == list(range(0, 900, 3)) and {r.score for r in got} == {1.0}


def test_edges(spark, tmp_path, monkeypatch):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", []), ("e", [1.0, 2.0, 3.0]), ("f", [1.0, float("nan")]), ("g", [1.0, 1.0]), ("g", [1.0, 1.0]), ("h", [None, 1.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "id string, embedding array<double>, cluster int")
    assert vector_index.build(vectors, "id", str(tmp_path / "one"))["dim"] == 2
    monkeypatch.setattr(vector_index, "SLICE", 1)
    got = vector_index.search(spark, str(tmp_path / "one"), vectors, "id", k=2).collect()
    assert sorted((r.question, r.key, r["rank"], round(r.score, 3)) for r in got if r.question == "a") == [("a", "a", 1, 1.0), ("a", "g", 2, 0.707)]
    assert vector_index.build(vectors.limit(0), "id", str(tmp_path / "two"))["clusters"] == 0
    assert vector_index.search(spark, str(tmp_path / "two"), vectors, "id").count() == 0
    assert vector_index.search(spark, str(tmp_path / "one"), vectors.limit(0), "id").columns == ["question", "key", "score", "rank"]


def test_query_is_whole(spark):
    d = "/root/testdata/sf0.001"
    got, true = registry.QUERIES["ann_topk"](spark, d), registry.QUERIES["dense_topk_batch"](spark, d)
    assert got.count() == true.count() and vector_index.recall_of(got, true).agg(F.avg("recall")).first()[0] >= 0.9


def test_exact_list_over_several_stretches(spark):
    """Copies tie by key, vectors of another length and a zero stand apart; a task has more rows than it holds at once."""
    draw = np.random.default_rng(4)
    some = draw.integers(-3, 4, size=(500, 3))
    rows = [(i, [float(x) for x in some[i % 500]]) for i in range(2 * vector_index.EXACT_ROWS + 300)] + [(9001, [1.0, 2.0]), (9002, [0.0, 0.0]), (9003, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    questions = vectors.filter("id in (7, 8, 1203, 9001)")
    got = {}
    for r in vector_index.exact(vectors, questions, "id", k=40).collect():
        got.setdefault(r.question, []).append((r["rank"], r.key, r.score))
    for number, v in rows:
        if number in (7, 8, 1203, 9001):
            cos = [(-round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 6), key) for key, w in rows if len(w) == len(v) and any(w)]
            assert sorted(got[number]) == [(n, key, -score) for n, (score, key) in enumerate(sorted(cos)[:40], 1)]
