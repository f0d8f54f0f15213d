"""Ranked search against scores of all documents, and against the query's SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from logloom.llm import queries, ranked_search

D = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """item_id to its (doc_id, score), by scoring every document."""
    bags = [(i, words(t)) for i, t in docs if words(t)]
    n, length = len(bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    asked = {}
    for i, t in items:
        asked[i] = asked.get(i, set()) | set(words(t))
    out = {}
    for item, terms in asked.items():
        found = []
        for i, w in bags:
            tf, m = Counter(w), 100 - 50 + (50 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((score, i))
        out[item] = [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]]
    return {i: v for i, v in out.items() if v}


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def test_op11_equals_sql_and_all_scores(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = queries.QUERIES["op11_ranked_search"](spark, D).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql("SELECT item_id, rank, doc_id, score FROM (" + queries.ORACLE_SQL["op11_ranked_search"] + ")").fetchall())
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{D}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(queries.QUERIES["op11_ranked_search"](spark, D)) == plain(docs, items, 50)


@pytest.mark.parametrize("block_docs,slice_items,most", [(4, 2, 10**6), (37, 500, 0), (4096, 500, 10**6)])
def test_ties_nulls_and_limits(spark, monkeypatch, block_docs, slice_items, most):
    """Blocks of any size, several slices, an index of all terms; many equal scores, some without an id."""
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "of", "réd", "Blue", "x1", "rare" + str(draw.randint(0, 40))]) for _ in range(draw.choice([1, 3, 8, 40]))) for _ in range(60)]
    docs = [(draw.randint(0, 500), draw.choice(texts)) for _ in range(400)] + [(None, texts[0]), (None, None), (7, ""), (8, "...")]
    items = [(1, "The of blue"), (2, texts[3]), (2, "rare7"), (3, None), (4, "absent"), (None, texts[5]), (5, texts[0] + " x1 x1")]
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(ranked_search, "SLICE_ITEMS", slice_items)
    monkeypatch.setattr(ranked_search, "MOST_TERMS", most)
    left = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id int, text string, block string, q int").repartition(3)
    right = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, doc_id string")
    got = rows_of(ranked_search.ranked_search(left, right, k=9))
    want = plain(docs, items, 9)
    assert got == want and len(want) == 4


def test_no_documents_or_questions(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0 and ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs, items).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_the_tree_prunes_and_opens_equal_bounds():
    """A block of 4,096 documents: bounds are never below a score of their range, few nodes are opened, ties all seen."""
    draw = np.random.default_rng(3)
    n, names = 4096, [f"t{i}" for i in range(40)]
    postings = [np.sort(draw.choice(n, size=int(n / (i + 2) ** 1.2) + 3, replace=False)) for i in range(40)]
    tfs = [draw.integers(1, 4, len(p)) for p in postings]
    sizes = draw.integers(20, 400, n)
    asked = ranked_search.Slice([], {t: i for i, t in enumerate(names)}, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * len(p) + 1))) for p in postings]), n, int(sizes.sum()))
    block = ranked_search.Block(np.arange(n)[::-1], sizes, names, np.array([len(p) for p in postings]), np.concatenate(postings), np.concatenate(tfs), asked)
    terms = np.array([1, 5, 20, 33, 39])
    scores = block.bounds(0, terms, np.arange(n))
    for level in range(1, len(block.levels)):
        nodes = block.levels[level][0]
        top = block.bounds(level, terms, np.arange(nodes))
        assert all(scores[i * 8 ** level:(i + 1) * 8 ** level].max() <= top[i] for i in range(nodes))
    opened = []
    bounds = block.bounds
    block.bounds = lambda level, t, at: (opened.append(len(at) if level == 0 else 0), bounds(level, t, at))[1]
    got = block.search(terms, 5, 0)
    want = sorted(zip(scores.tolist(), block.ids.tolist()), key=lambda x: (-x[0], x[1]))[:5]
    assert sorted(got, key=lambda x: (-x[0], x[1])) == want and sum(opened) < n / 2
    assert block.search(terms, 5, want[2][0]) and {x for x in block.search(terms, 5, want[2][0]) if x[0] >= want[2][0]} >= set(want[:3])
