"""Spelling groups against every pair of words, and against the query's SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, spelling

D = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, form = [], {}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_op12_equals_sql_and_all_pairs(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = rows_of(queries.QUERIES["op12_spelling"](spark, D))
    assert got == sorted(con.sql("SELECT word, form, root, n, n_near, form_n FROM (" + queries.ORACLE_SQL["op12_spelling"] + ")").fetchall(), key=str)
    assert got == plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]) and len(got) > 500


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_crowded_halves(spark, crowd):
    """Many words under one half, runs of one letter, letters beyond ASCII, chains of forms."""
    draw = random.Random(crowd)
    made = {"aaaaaa" + "".join(draw.choice("abé") for _ in range(draw.randint(0, 4))) for _ in range(150)}
    made |= {"".join(draw.choice("abÿ") for _ in range(draw.randint(0, 4))) + "bbbbbbb" for _ in range(150)}
    made |= {"a" * k for k in range(6, 16)} | {"longer" * 40, "longer" * 40 + "r", "langer" + "longer" * 39}
    rows = []
    for k, word in enumerate(sorted(made)):
        rows += [(k * 1000 + i, f"-{word} {word.upper() if word.isascii() else word}") for i in range(draw.choice([3, 3, 4, 20, 120]))]
    chain = [("chainword", 5), ("chainwordx", 30), ("chainwordxy", 160), ("chainwordxyz", 900)]
    rows += [(-k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert rows_of(spelling.group_spellings(docs, crowd)) == want
    assert [w[2] for w in want if w[0] == "chainword"] == ["chainwordxyz"] and max(w[4] for w in want) > 5


def test_each_pair_once(spark):
    counted = spark.createDataFrame([(w, 5) for w in ("aaaaaaa", "aaaaaa", "aabaaa", "abaaaa", "baaaaa", "aaaaaaaa")], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near(counted, crowd=1).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, _ in counted.collect() for b, _ in counted.collect() if one_edit(a, b)}


def test_edges(spark):
    rows = [(None, "néarlyword " * 5), (1, None), (2, ""), (3, "short " * 50), (4, "×÷×÷×÷ " * 6), (4, "×÷×÷×÷ " * 6), (5, "x" * 50_000 + " " + "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id long, text string, word string, key int")
    assert rows_of(spelling.group_spellings(docs)) == plain(rows)
    assert spelling.group_spellings(docs.limit(0)).count() == 0
    assert rows_of(spelling.group_spellings(docs.filter(F.col("doc_id") == 5).unionByName(docs.filter(F.col("doc_id") == 5)).unionByName(docs.filter(F.col("doc_id") == 5)))) == plain(rows[-1:] * 3)
