"""Exact ranked lexical search of many questions at once by best-first branch and bound.

Documents are indexed where they are read, in ranges (blocks) of at most 4,096, without a shuffle: a block is one row with
the postings of its terms. Over each term's postings stands a tree of maxima: a node holds the best score that the term
gives to a document of its range, eight ranges make the next one, and the block is the root. A node's bound for a question
is the sum of its terms' maxima. A search opens the node of the highest bound first and stops where no bound reaches the
k-th score; nodes whose bound equals it are opened, as an equal score with a smaller id goes first.

The blocks of all tasks are one more level of that tree. First the bounds of all roots are taken and each question's best
block is searched; its k-th score is a floor for the whole corpus. Then only blocks and nodes that reach the floor are
opened, so a task hands on few rows. To the driver come one block and one floor a question, and the document counts of
the questions' terms. Questions are asked in slices of bounded number and bytes; only a slice is broadcast.

Terms are maximal runs of the digits, letters and all code points beyond ASCII; A-Z are lower-cased. Null and empty texts
have no terms, and a question without terms gets no rows. Questions that share an id are one question. Repeated documents
are ranked one by one; equal scores go by doc_id, those without one last. Long texts are read whole. No documents or no
questions give no rows. Columns besides the ids and texts are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Documents and postings of a block, and ranges under a node.
BLOCK_DOCS, BLOCK_POSTINGS, FAN = 4096, 1 << 18, 8
#: Nodes opened at a time.
OPENED = 16
#: Questions, and bytes of their texts, of a slice; terms that an index for given questions is limited to.
SLICE_ITEMS, SLICE_BYTES, MOST_TERMS = 500, 16 << 20, 500_000
NO_ID = (1 << 63) - 1

_ints, _long = pa.list_(pa.int32()), pa.int64()
BLOCK = pa.schema([("block", _long), ("n_docs", _long), ("n_terms", _long), ("ids", pa.list_(_long)), ("sizes", _ints),
                   ("terms", pa.list_(pa.string())), ("lengths", _ints), ("docs", _ints), ("tfs", _ints)])
BLOCK_TYPE = "block long, n_docs long, n_terms long, ids array<long>, sizes array<int>, terms array<string>, lengths array<int>, docs array<int>, tfs array<int>"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


class Growing:
    """A block that is being filled."""

    def __init__(self):
        self.n_docs = self.n_terms = 0
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.names: dict[bytes, int] = {}
        self.term: list[int] = []
        self.doc: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, size: int, counts: dict[bytes, int]) -> None:
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + size
        if not counts:
            return
        self.term += [self.names.setdefault(t, len(self.names)) for t in counts]
        self.doc += [len(self.ids)] * len(counts)
        self.tf += counts.values()
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(size)

    def full(self) -> bool:
        return self.n_docs >= BLOCK_DOCS or len(self.doc) >= BLOCK_POSTINGS

    def row(self, block: int) -> pa.RecordBatch:
        order = np.argsort(np.array(self.term, dtype=np.int64), kind="stable")
        one = lambda x: [np.array(x, dtype=np.int32)]
        lengths = np.bincount(np.array(self.term, dtype=np.int64), minlength=len(self.names))
        columns = [[block], [self.n_docs], [self.n_terms], [np.array(self.ids, dtype=np.int64)], one(self.sizes), [[t.decode("utf-8", "replace") for t in self.names]],
                   one(lengths), [np.array(self.doc, dtype=np.int32)[order]], [np.array(self.tf, dtype=np.int32)[order]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCK)], schema=BLOCK)


def index(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text), to be stored or searched. With ``asked`` (item_id, text) only postings of terms
    of those questions are kept, where these are few enough to be broadcast; all documents and terms are counted."""
    spark, only = docs.sparkSession, None
    if asked is not None:
        vocabulary = cut(asked.select(F.explode(terms_of(F.col("text"))).alias("term")).distinct())
        if vocabulary.count() <= MOST_TERMS:
            only = spark.sparkContext.broadcast({r["term"].encode() for r in vocabulary.toLocalIterator()})
    find = TERM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keep = re.compile(find).findall, None if only is None else only.value
        now, number = Growing(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words((text.as_py() or b"").translate(LOWER))
                if not found:
                    continue
                now.add(doc_id, len(found), Counter(found if keep is None else filter(keep.__contains__, found)))
                if now.full():
                    yield now.row(number)
                    now, number = Growing(), number + 1
        if now.n_docs:
            yield now.row(number)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, BLOCK_TYPE)


@dataclass
class Slice:
    """Some questions: for each the numbers of its terms; terms with their numbers and weights; documents and terms of all."""
    items: list[np.ndarray]
    numbers: dict[str, int]
    weights: np.ndarray
    n: int
    length: int


class Block:
    """A block with the trees of a slice's terms: for each level sorted keys ``term * nodes + node`` and their maxima."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: list[str], lengths: np.ndarray, docs: np.ndarray, tfs: np.ndarray, asked: Slice):
        self.ids = ids
        own = np.array([asked.numbers.get(t, -1) for t in terms], dtype=np.int64)
        term = np.repeat(own, lengths)
        mine = np.flatnonzero(term >= 0)
        term, doc, tf = term[mine], docs[mine].astype(np.int64), tfs[mine].astype(np.int64)
        m = 50 + 50 * sizes.astype(np.int64) * asked.n // max(asked.length, 1)
        best = asked.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.levels, nodes = [], max(1, len(ids))
        order = np.argsort(term * nodes + doc, kind="stable")
        key, best = (term * nodes + doc)[order], best[order]
        while True:
            self.levels.append((nodes, key, best))
            if nodes == 1:
                break
            above = -(-nodes // FAN)
            up = key // nodes * above + key % nodes // FAN
            starts = np.flatnonzero(np.diff(up, prepend=-1))
            key, best = up[starts], np.maximum.reduceat(best, starts) if len(starts) else best[:0]
            nodes = above

    def bounds(self, level: int, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The sum of the terms' maxima for each node ``at``."""
        nodes, key, best = self.levels[level]
        if not len(key) or not len(terms):
            return np.zeros(len(at), dtype=np.int64)
        want = terms[:, None] * nodes + at[None, :]
        place = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[place] == want, best[place], 0).sum(axis=0)

    def root(self, terms: np.ndarray) -> int:
        return int(self.bounds(len(self.levels) - 1, terms, np.zeros(1, dtype=np.int64))[0])

    def search(self, terms: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, id) of the k best documents that reach ``floor`` and have a score above 0."""
        kept: list[tuple[int, int]] = []  # score and negative id: the worst of the kept first
        limit, root = max(floor, 1), self.root(terms)
        top = len(self.levels) - 1
        open_nodes = [(-root, top, 0)] if root >= limit else []
        if top == 0:
            return [(root, int(self.ids[0]))] if open_nodes else []
        while open_nodes and -open_nodes[0][0] >= limit:
            level, at = open_nodes[0][1], []
            while open_nodes and len(at) < OPENED and open_nodes[0][1] == level and -open_nodes[0][0] >= limit:
                at.append(heapq.heappop(open_nodes)[2])
            below = (np.array(at, dtype=np.int64)[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < self.levels[level - 1][0]]
            bounds = self.bounds(level - 1, terms, below)
            reach = np.flatnonzero(bounds >= limit)
            for node, bound in zip(below[reach].tolist(), bounds[reach].tolist()):
                if level > 1:
                    heapq.heappush(open_nodes, (-bound, level - 1, node))
                    continue
                heapq.heappush(kept, (bound, -int(self.ids[node])))
                if len(kept) > k:
                    heapq.heappop(kept)
            if len(kept) == k:
                limit = max(limit, kept[0][0])
        return [(score, -less) for score, less in kept]


def blocks_of(batches: Iterator[pa.RecordBatch], asked: Slice) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        array = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        for i, number in enumerate(batch.column("block").to_pylist()):
            yield number, Block(array("ids", i), array("sizes", i), batch.column("terms")[i].as_py(), *(array(c, i) for c in ("lengths", "docs", "tfs")), asked)


def best_blocks(blocks: DataFrame, given) -> dict[int, int]:
    """Each question's block of the highest root bound; a task hands on one row a question."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = given.value, {}
        for number, block in blocks_of(batches, asked):
            for q, terms in enumerate(asked.items):
                bound = block.root(terms)
                if bound > best.get(q, (0, 0))[0]:
                    best[q] = (bound, number)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), _long), pa.array([b for b, _ in best.values()], _long), pa.array([n for _, n in best.values()], _long)], ["q", "bound", "block"])
    seen = blocks.mapInArrow(work, "q long, bound long, block long").groupBy("q").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    return {r["q"]: r["block"] for r in seen.collect()}


def search_blocks(blocks: DataFrame, given, k: int, floors: dict[int, int], only: dict[int, int] | None = None) -> DataFrame:
    """``q, doc_id, score``: the k best of each block that reach the floor; with ``only``, of one block a question."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = given.value
        for number, block in blocks_of(batches, asked):
            rows = [(q, i, s) for q, terms in enumerate(asked.items) if only is None or only.get(q) == number for s, i in block.search(terms, k, floors.get(q, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), _long) for c in (zip(*rows) if rows else ([], [], []))], ["q", "doc_id", "score"])
    return blocks.mapInArrow(work, "q long, doc_id long, score long")


def search(blocks: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents for each of ``items`` (item_id, text).

    ``blocks`` (of ``index``) is read some times: give it checkpointed or stored.
    """
    spark, kind = blocks.sparkSession, items.schema["item_id"]
    whole = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("length")).first()
    size = items.agg(F.countDistinct("item_id").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-size["n"] // SLICE_ITEMS), -(-size["bytes"] // SLICE_BYTES))
    terms = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    terms = cut(terms.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices))))
    found = spark.createDataFrame([], T.StructType([kind, *T.StructType.fromDDL("rank int, doc_id long, score long").fields]))
    for number in range(slices):
        rows = terms.filter(F.col("slice") == number).orderBy("item_id").collect()
        names = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        if not names or not whole["n"]:
            continue
        wanted = spark.createDataFrame([(t,) for t in names], "term string")
        held = blocks.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.lengths").alias("df"))
        held = {r["term"]: r["df"] for r in held.join(wanted, "term", "left_semi").collect()}
        weights = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * held.get(t, 0) + 1))) for t in names], dtype=np.int64)
        asked = Slice([np.array(sorted(names[t] for t in r["terms"]), dtype=np.int64) for r in rows], names, weights, whole["n"], whole["length"])
        given = spark.sparkContext.broadcast(asked)
        seeds = best_blocks(blocks, given)
        first = search_blocks(blocks.filter(F.col("block").isin(sorted(set(seeds.values())))), given, k, {}, seeds)
        floors = {r["q"]: r["floor"] for r in first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).collect()}
        hits = search_blocks(blocks, given, k, floors)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        hits = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
        own = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", kind.dataType)]))
        hits = hits.join(F.broadcast(own), "q").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
        found = found.unionByName(hits)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over an index of ``docs`` that holds what ``items`` ask."""
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    return search(cut(index(docs, items)), items, k)
