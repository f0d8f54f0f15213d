"""A partitioned vector index: coarse clusters, and within each cluster short codes of what the centroid leaves.

``build`` fits centroids and code books on a bounded sample, then indexes every vector: a table partitioned by cluster, with
the vector's code and the vector itself. ``search`` takes a table of questions. Each probes its nearest clusters; the scan
reads these folders only, and of them only keys and codes. A task keeps the best codes of each question, so what moves is a
few rows a task and question whatever the size of a cluster; the few best are then scored by their exact vectors.

How many clusters a question must probe depends on the data: where vectors lie in groups a few are enough, where they lie
anywhere on the sphere most are needed. ``build`` measures that on questions from the sample, and ``search`` takes the
fewest probes that gave the recall asked for.

Null, empty and zero vectors and those of another length than most in the sample aren't indexed: they have no cosine. Repeated keys
are separate rows. An empty table gives an index that finds nothing. Scores are cosines rounded as ``retrieval.dense`` does.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared

#: Vectors of the sample, code books (parts of a vector) and codes of one; questions asked in one pass.
SAMPLE, PARTS, CODES, SLICE = 20_000, 16, 64, 2_000
#: Vectors that the exact scan holds against all questions of a slice at once.
EXACT_ROWS = 1_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _means(x: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """Lloyd's centroids of the sample ``x``; an empty cluster starts anew at the vector that fits worst."""
    own = x[draw.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        far = (own * own).sum(axis=1)[None, :] - 2 * x @ own.T
        at = far.argmin(axis=1)
        n = np.bincount(at, minlength=len(own))
        total = np.zeros_like(own)
        np.add.at(total, at, x)
        empty = np.flatnonzero(n == 0)
        total[empty] = x[np.argsort(far.min(axis=1) + (x * x).sum(axis=1))[::-1][:len(empty)]]
        own = total / np.maximum(n, 1)[:, None]
    return own


class Books:
    """Centroids ``c`` (clusters x dim) and code books ``b`` (parts x codes x width); small, as the sample is."""

    def __init__(self, c: np.ndarray, b: np.ndarray, curve: list[float]):
        self.c, self.b, self.curve = c, b, curve
        self.cuts = np.arange(b.shape[0] + 1) * b.shape[2]

    @classmethod
    def fit(cls, x: np.ndarray, clusters: int, parts: int, codes: int, seed: int) -> Books:
        draw = np.random.default_rng(seed)
        x = _unit(x)
        c = _means(x, clusters, 12, draw)
        width = -(-x.shape[1] // parts)
        rest = np.pad(x - c[cls.near(x, c)], ((0, 0), (0, width * parts - x.shape[1])))
        books = [_means(rest[:, i * width:(i + 1) * width], codes, 10, draw) for i in range(parts)]
        return cls(c, np.stack(books), cls.measured(x, c, draw))

    @staticmethod
    def measured(x: np.ndarray, c: np.ndarray, draw: np.random.Generator, questions: int = 300, k: int = 50) -> list[float]:
        """The mean share of a vector's k nearest in the sample that lie in its p nearest clusters, for each p."""
        own, at, share = draw.choice(len(x), size=min(questions, len(x)), replace=False), Books.near(x, c), np.zeros(len(c))
        for q in x[own]:
            k_best = np.argsort(-(x @ q))[:k]
            place = np.empty(len(c), dtype=int)
            place[np.argsort(-(2 * c @ q - (c * c).sum(axis=1)))] = np.arange(len(c))
            share += np.bincount(place[at[k_best]], minlength=len(c)).cumsum() / len(k_best)
        return (share / len(own)).tolist()

    def probes(self, recall: float) -> int:
        return next((p for p, r in enumerate(self.curve, 1) if r >= recall), len(self.c))

    @staticmethod
    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.cuts[-1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and codes (rows x parts, bytes) of unit vectors."""
        at = self.near(x, self.c)
        rest = self.padded(x - self.c[at])
        return at, np.stack([self.near(rest[:, a:b], self.b[i]) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Dot products of questions with each code: questions x parts x codes."""
        q = self.padded(q).reshape(len(q), self.b.shape[0], self.b.shape[2])
        return np.einsum("qpw,pcw->qpc", q, self.b)

    def save(self) -> str:
        return json.dumps({"c": self.c.tolist(), "b": self.b.tolist(), "curve": self.curve})

    @classmethod
    def load(cls, text: str) -> Books:
        data = json.loads(text)
        return cls(np.array(data["c"]), np.array(data["b"]), data["curve"])


def _usable(column: str) -> Column:
    return F.col(column).isNotNull() & F.exists(column, lambda x: x != 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x))


def build(vectors: DataFrame, key: str, path: str, column: str = "embedding", clusters: int | None = None, sample: int = SAMPLE, parts: int = PARTS, codes: int = CODES, seed: int = 7) -> dict:
    """Write the index of ``vectors`` (key, column) to ``path``; returns its facts.

    The fit reads ``sample`` vectors at most, drawn by a hash of the key (of any size of table); all vectors are indexed.
    Without ``clusters`` there are as many as the square root of the number of vectors, and the sample fits at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("embedding")).filter(_usable("embedding"))
    n = rows.count()
    share = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(seed)), F.lit(1_000_000)) < max(1, min(1_000_000, 1_200_000 * sample // max(n, 1)))
    drawn = [r["embedding"] for r in rows.filter(share).limit(sample).collect()]
    dim = Counter(map(len, drawn)).most_common(1)[0][0] if drawn else 0
    x = np.array([v for v in drawn if len(v) == dim], dtype=np.float64).reshape(-1, max(dim, 1))
    k = clusters or max(1, min(int(n ** 0.5), len(x) // 8))
    books = Books.fit(x, k, min(parts, max(dim, 1)), codes, seed) if dim else None
    facts = {"vectors": n, "dim": dim, "clusters": len(books.c) if books else 0, "sampled": len(x), "probes_95": books.probes(0.95) if books else 0}
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("code", T.BinaryType()), T.StructField("embedding", rows.schema["embedding"].dataType), T.StructField("cluster", T.IntegerType())])
    if books:
        given = spark.sparkContext.broadcast(books)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                    at, code = given.value.encode(_unit(own))
                    yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding"), pa.array(at, pa.int32())], names=schema.names)
        coded = rows.filter(F.size("embedding") == dim).mapInArrow(work, schema)
    else:
        coded = spark.createDataFrame([], schema)
    # By range, so that a cluster with many vectors is several files and several tasks.
    coded.repartitionByRange("cluster", "key").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/codes")
    spark.createDataFrame([(json.dumps(facts), books.save() if books else "")], "facts string, books string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return facts


def search(spark: SparkSession, path: str, questions: DataFrame, key: str, k: int = 50, recall: float = 0.95, probes: int | None = None, again: int = 4,
           column: str = "embedding", skip_self: bool = False) -> DataFrame:
    """``question, key, score, rank``: about the k nearest vectors of each of ``questions`` (key, column).

    As many clusters are read for each as gave ``recall`` on the sample, or ``probes``; the ``again * k`` best by their
    codes are scored exactly. Questions are asked in slices of bounded number, one pass each.
    """
    model = spark.read.parquet(f"{path}/model").first()
    facts = json.loads(model["facts"])
    kind = questions.schema[key].dataType
    asked = questions.select(F.col(key).alias("question"), F.col(column).alias("vector")).filter(_usable("vector") & (F.size("vector") == facts["dim"]))
    out = None
    if facts["dim"]:
        books, slices = Books.load(model["books"]), max(1, -(-asked.count() // SLICE))
        for number in range(slices):
            rows = asked.filter(F.pmod(F.xxhash64(F.col("question").cast("string")), F.lit(slices)) == number).collect()
            if rows:
                found = _slice(spark, path, rows, kind, books, k, probes or books.probes(recall), again, skip_self)
                out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    known = spark.read.parquet(f"{path}/codes").schema["key"].dataType if facts["dim"] else kind
    return spark.createDataFrame([], T.StructType([T.StructField("question", kind), T.StructField("key", known), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))


def _slice(spark: SparkSession, path: str, rows: list, kind: T.DataType, books: Books, k: int, probes: int, again: int, skip_self: bool) -> DataFrame:
    q = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
    near = np.argsort(-(2 * q @ books.c.T - (books.c * books.c).sum(axis=1)), axis=1)[:, :probes]
    wanted: dict[int, list[int]] = {}
    for i, row in enumerate(near.tolist()):
        for cluster in row:
            wanted.setdefault(cluster, []).append(i)
    given = spark.sparkContext.broadcast((books, q, wanted))
    codes = probed(spark, path, sorted(wanted)).select("cluster", "key", "code")
    keep = again * k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, q, wanted = given.value
        tables, parts, best = books.tables(q), np.arange(books.b.shape[0]), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("cluster").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, books.b.shape[0])
            for cluster in np.unique(at).tolist():
                mine = np.flatnonzero(at == cluster)
                for i in wanted.get(cluster, ()):
                    score = tables[i][parts[None, :], code[mine]].sum(axis=1) + q[i] @ books.c[cluster]
                    keys = batch.column("key").take(pa.array(mine))
                    old = best.get(i)
                    if old is not None:
                        score, keys = np.concatenate([old[0], score]), pa.concat_arrays([old[1], keys])
                    if len(score) > keep:
                        top = np.sort(np.argpartition(-score, keep)[:keep])
                        score, keys = score[top], keys.take(pa.array(top))
                    best[i] = (score, keys)
        for i, (score, keys) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), keys, pa.array(score)], names=["q", "key", "near"])
    schema = T.StructType([T.StructField("q", T.IntegerType()), codes.schema["key"], T.StructField("near", T.DoubleType())])
    by_code = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "key"))
    few = codes.mapInArrow(work, schema).withColumn("_n", by_code).filter(F.col("_n") <= keep).select("q", "key")
    asked = spark.createDataFrame([(i, r["question"], [float(x) for x in r["vector"]]) for i, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("question", kind), T.StructField("vector", T.ArrayType(T.DoubleType()))]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    own = F.transform("embedding", lambda x: x.cast("double"))
    exact = probed(spark, path, sorted(wanted)).select("key", "embedding").join(few.distinct(), "key").join(F.broadcast(asked), "q")
    exact = exact.select("question", "key", F.round(dot(own, F.col("vector")) / F.sqrt(dot(own, own) * dot(F.col("vector"), F.col("vector"))), 6).alias("score"))
    exact = exact.filter(F.col("question") != F.col("key")) if skip_self else exact
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "key"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)


def probed(spark: SparkSession, path: str, clusters: list[int]) -> DataFrame:
    """The index's rows of some clusters; the plan's partition filter leaves the other folders unread."""
    return spark.read.parquet(f"{path}/codes").filter(F.col("cluster").isin(clusters))


def _keep(best: dict[int, tuple[np.ndarray, pa.Array]], i: int, score: np.ndarray, keys: pa.Array, k: int) -> float:
    """Put what may be among the k best of question ``i`` to what is kept, equal scores by key; the score that others must reach."""
    if len(score) > k:
        worst = np.partition(-score, k - 1)[k - 1]
        own = np.arange(len(score)) if np.isnan(worst) else np.flatnonzero(-score <= worst)
        score, keys = score[own], keys.take(pa.array(own))
    if i in best:
        score, keys = np.concatenate([best[i][0], score]), pa.concat_arrays([best[i][1], keys])
    top = np.lexsort((np.array(keys.to_pylist()), -score))[:k]
    best[i] = (score[top], keys.take(pa.array(top)))
    last = best[i][0][-1] if len(top) == k else np.nan
    return -np.inf if np.isnan(last) else float(last)


def exact(vectors: DataFrame, questions: DataFrame, key: str, k: int = 50, column: str = "embedding") -> DataFrame:
    """What ``search`` is held to: ``question, key, score, rank`` by all cosines, in one scan.

    Questions are a stated set, asked in slices; each task holds ``EXACT_ROWS`` vectors against a slice at once and keeps its k
    best a question before anything moves.
    """
    spark, kind = vectors.sparkSession, questions.schema[key].dataType
    asked = questions.select(F.col(key).alias("question"), F.col(column).alias("vector")).filter(_usable("vector"))
    slices, out = max(1, -(-asked.count() // SLICE)), None
    rows = vectors.select(F.col(key).alias("key"), F.transform(column, lambda x: x.cast("double")).alias("v")).filter(_usable("v"))
    for number in range(slices):
        some = asked.filter(F.pmod(F.xxhash64(F.col("question").cast("string")), F.lit(slices)) == number).collect()
        given = spark.sparkContext.broadcast(some)

        def work(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, pa.Array]] = {}
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(given.value):
                by_size.setdefault(len(r["vector"]), []).append(i)
            asked = {size: np.array([given.value[i]["vector"] for i in own], dtype=np.float64) for size, own in by_size.items()}
            floor = {size: np.full(len(own), -np.inf) for size, own in by_size.items()}
            for batch in (b.slice(i, EXACT_ROWS) for b in batches for i in range(0, len(b), EXACT_ROWS)):
                sizes = np.array([len(v) for v in batch.column("v")])
                for size, own in by_size.items():
                    mine = np.flatnonzero(sizes == size)
                    if not len(mine):
                        continue
                    part, q = batch.column("v").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), size), asked[size]
                    near = np.round(q @ part.T / np.sqrt(np.outer((q * q).sum(axis=1), (part * part).sum(axis=1))), 6)
                    names = batch.column("key").take(pa.array(mine))
                    # Nothing that is not a number reaches a floor; it counts only while there are fewer than k.
                    for j in np.flatnonzero((near >= floor[size][:, None]).any(axis=1) | (floor[size] == -np.inf)).tolist():
                        floor[size][j] = _keep(best, own[j], near[j], names, k)
            for i, (score, keys) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), keys, pa.array(score)], names=["q", "key", "score"])
        schema = T.StructType([T.StructField("q", T.IntegerType()), rows.schema["key"], T.StructField("score", T.DoubleType())])
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
        names = spark.createDataFrame([(i, r["question"]) for i, r in enumerate(some)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("question", kind)]))
        found = rows.mapInArrow(work, schema).withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "q").select("question", "key", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """``question, recall``: the share of its true neighbours that were found."""
    hit = true.select("question", "key").join(found.select("question", "key", F.lit(1).alias("hit")).distinct(), ["question", "key"], "left")
    return hit.groupBy("question").agg((F.count("hit") / F.count("*")).alias("recall"))
