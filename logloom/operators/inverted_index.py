"""A stored inverted index for BM25: postings by term in blocks of documents, block maxima, early stopping.

``write`` turns a table of texts into rows of (term, block): the block's documents that hold the term, with counts and
lengths, and the largest part of a score that the term gives in it. A term that most documents hold is many rows, one for each
block of about ``BLOCK`` documents. Files lie in folders by a hash of the term and are sorted by term, so a question
opens its terms' folders and, of their row groups, those that hold them.

``search`` reads the maxima of the question's terms first. The sum over its terms bounds every score of a block. The blocks of
the highest bounds are scored; their k-th score is what any other block must be able to reach, and only those that are
are read. The result is that of ``retrieval.bm25`` over all texts.

Null and empty texts have no terms but count as documents. Repeated keys are documents of their own whose scores add up.
A question without known terms, an empty table and a ``k`` of 0 give no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import tokenize
from ..shared import cut
from .retrieval import B, EPSILON, K1, Terms, document_terms, lengths, ranked, term_counts, texts_of

#: Documents of a block on average, and folders that the terms are dealt over.
BLOCK, BUCKETS = 512, 64


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term gives to a score besides its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def counted(tokens: Column) -> Column:
    """``term, tf`` of each distinct token: the runs of the sorted tokens, in time n log n."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).alias("tf")))
    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) > 0, let(F.array_sort(tokens), lambda s: let(begins(s), lambda b: runs(s, b)))).otherwise(none)


def write(docs: DataFrame, key: str, path: str, text: str = "text", max_tokens: int | None = None, block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Write ``stats`` (one row) and ``postings`` below ``path``.

    Terms are counted where the texts are read, and the counts move once, by folder, term and block; a folder is written by
    about as many tasks as there are shuffle partitions for each folder.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = document_terms(docs, key, text, max_tokens).filter("term is not null")
    each = lengths(docs, text, max_tokens)
    stats = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl") / F.sum("n"), F.lit(0.0)).alias("avgdl")).withColumns({"blocks": F.ceil(F.col("n") / block).cast("long"), "buckets": F.lit(buckets), "max_tokens": F.lit(max_tokens).cast("int")})
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts").first()
    avgdl = F.lit(facts["avgdl"])
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(max(1, facts["blocks"])))
    entry = F.struct(F.col(key).alias("key"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    place = ["bucket", "part", "term", "block"]
    rows = rows.withColumns({"block": at, "bucket": bucket_of(F.col("term"), buckets)}).withColumn("part", F.pmod(F.xxhash64("term", "block"), F.lit(parts)))
    grouped = rows.repartition(parts * buckets, "bucket", "part").groupBy(*place).agg(
        F.max(_part(F.col("tf"), F.col("dl"), avgdl)).alias("most"), F.count("*").cast("int").alias("df"), F.collect_list(entry).alias("entries"))
    grouped = grouped.sortWithinPartitions("bucket", "term", "block").drop("part")
    grouped.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # The mean of the raw idf, which rare forms of the formula need, takes the terms' counts alone.
    n = F.lit(float(facts["n"]))
    schema = grouped.schema.json()
    counts = _stored(spark, path, schema).groupBy("term").agg(F.sum("df").alias("df"))
    mean = counts.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean"), F.count("*").alias("terms"))
    mean.select(*(F.lit(facts[c]).alias(c) for c in ("n", "avgdl", "blocks", "buckets")), F.lit(facts["max_tokens"]).cast("int").alias("max_tokens"), "mean", "terms", F.lit(schema).alias("schema")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/postings")


def of_terms(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms: their folders by the partition filter, their row groups by the filter of the scan."""
    stats = spark.read.parquet(f"{path}/stats").first()
    rows = _stored(spark, path, stats["schema"])
    if not terms:
        return rows.limit(0)
    buckets = stats["buckets"]
    at = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), buckets).alias("b")).distinct().collect()
    return rows.filter(F.col("bucket").isin(sorted(r["b"] for r in at)) & F.col("term").isin(sorted(terms)))


def search(spark: SparkSession, path: str, question: str, k: int = 50, first: int = 8, key: str = "key") -> DataFrame:
    """``key, score, rank`` of the k best documents; ``first`` blocks are scored to find what the others must reach."""
    stats = spark.read.parquet(f"{path}/stats").first()
    asked = Counter(spark.range(1).select(tokenize(F.lit(question)).alias("t")).first()["t"])
    rows = of_terms(spark, path, list(asked))
    kind = rows.schema["entries"].dataType.elementType["key"].dataType
    none = spark.range(0).select(F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if k <= 0 or not asked:
        return none
    # One row a term of the question.
    held = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    if not held:
        return none
    raw = F.log(F.lit(float(stats["n"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    given = spark.createDataFrame([(t, d, asked[t]) for t, d in held.items()], "term string, df long, times int").select(
        "term", (F.col("times") * F.when(raw < 0, EPSILON * stats["mean"]).otherwise(raw)).alias("weight"))
    weights = {r["term"]: r["weight"] for r in given.collect()}
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("term"))

    def scored(part: DataFrame) -> DataFrame:
        e = part.select("term", F.explode("entries").alias("e"))
        return e.groupBy(F.col("e.key").alias(key)).agg(F.round(F.sum(weight * _part(F.col("e.tf"), F.col("e.dl"), F.lit(stats["avgdl"]))), 6).alias("score"))
    # A negative weight lowers a score, so it doesn't count in the bound.
    bounds = rows.groupBy("block").agg(F.sum(F.greatest(weight, F.lit(0.0)) * F.col("most")).alias("bound"))
    best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
    floor = scored(rows.filter(F.col("block").isin(best))).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("floor")).first()
    if floor["n"] < k:
        return ranked(scored(rows), key, k)
    # Scores are rounded to six places.
    reach = bounds.filter(F.col("bound") >= floor["floor"] - 1e-6).select("block")
    return ranked(scored(rows.join(reach, "block", "left_semi")), key, k)


#: Questions of a batch whose terms are broadcast at once, and documents that a task scores at once.
SLICE, HELD = 500, 256


def search_all(docs: DataFrame, key: str, questions: DataFrame, k: int = 50, text: str = "text", counts: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """``question, key, score, rank`` of a table of questions (``question, text``): for each what ``bm25`` finds.

    The documents are read once for ``SLICE`` questions, whose terms are broadcast, and once before for the counts, unless
    they are given. Each task keeps its k best a question, so at most k rows a task and question move. A question that is null, blank or
    without known terms has no rows; one that repeats is an error; null keys are left out.
    """
    spark, kind = docs.sparkSession, questions.schema["question"].dataType
    counts = cut(term_counts(docs, text, max_tokens)) if counts is None else counts
    whole = counts.filter("term is null").first()
    terms = questions.filter("question is not null and text is not null").select("question", F.explode(counted(tokenize(F.col("text")))).alias("x"))
    empty = docs.select(F.lit(None).cast(kind).alias("question"), F.col(key).alias("key")).limit(0).selectExpr("question", "key", "0d as score", "0 as rank")
    if whole is None or k <= 0:
        return empty
    raw = F.log(F.lit(whole["df"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = counts.filter("term is not null").agg(F.avg(raw)).first()[0]
    idf = counts.filter("term is not null").select("term", F.when(raw < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(raw).alias("idf"))
    asked = cut(terms.select("question", F.col("x.term").alias("term"), F.col("x.tf").alias("times")).join(idf, "term").select("question", "term", (F.col("times") * F.col("idf")).alias("w")))
    slices = max(1, -(-asked.select("question").distinct().count() // SLICE))
    avgdl = (whole["dl"] or 0) / whole["df"]
    rows = texts_of(docs.filter(F.col(key).isNotNull()).withColumn("key", F.col(key)), text, "key")
    out = None
    for number in range(slices):
        some = sorted((r["question"], r["term"], r["w"]) for r in asked.filter(F.pmod(F.xxhash64("question"), F.lit(slices)) == number).collect())
        names = sorted({q for q, _, _ in some})
        if len({(q, t) for q, t, _ in some}) < len(some):
            raise ValueError("questions repeat")
        place, known = {q: i for i, q in enumerate(names)}, sorted({t for _, t, _ in some})
        of_term = {t: i for i, t in enumerate(known)}
        some = sorted((of_term[t], place[q], w) for q, t, w in some)
        codes, at, w = (np.array([x[i] for x in some]) for i in range(3))
        given = spark.sparkContext.broadcast((len(names), known, np.searchsorted(codes, np.arange(len(known) + 1)), at, w))
        found = rows.mapInArrow(lambda batches, given=given: _best(batches, *given.value, avgdl, k, max_tokens), T.StructType([T.StructField("q", T.IntegerType()), rows.schema["key"], T.StructField("score", T.DoubleType())]))
        named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("question", kind)]))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
        one = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(named, "q").select("question", "key", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _best(batches: Iterator[pa.RecordBatch], n: int, known: list[str], first: np.ndarray, asked: np.ndarray, weight: np.ndarray, avgdl: float, k: int, max_tokens: int | None = None) -> Iterator[pa.RecordBatch]:
    """The task's k best documents of each of ``n`` questions, equal scores by key.

    Term i of ``known`` is asked by the questions ``asked[first[i]:first[i + 1]]``; only such terms are looked at.
    """
    best: dict[int, tuple[np.ndarray, pa.Array]] = {}
    terms, code_of = Terms(max_tokens), {t: i for i, t in enumerate(known)}
    for batch in (b.slice(i, HELD) for b in batches for i in range(0, len(b), HELD)):
        dl, pair, tf = np.zeros(len(batch)), [], []
        for i, value in enumerate(batch.column("_text")):
            own = terms.of(value.as_py())
            dl[i] = len(own)
            counts = Counter(c for c in map(code_of.get, own) if c is not None)
            pair += [i * len(known) + c for c in sorted(counts)]
            tf += [counts[c] for c in sorted(counts)]
        pair, tf = np.array(pair, np.int64), np.array(tf, np.int64)
        doc, code = pair // max(1, len(known)), pair % max(1, len(known))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / max(avgdl, 1e-300)))
        times = first[code + 1] - first[code]
        entry = np.repeat(first[code] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum()) if len(code) else np.empty(0, np.int64)
        cell = np.repeat(doc, times) * n + asked[entry.astype(np.int64)].astype(np.int64)
        score = np.bincount(cell, weight[entry.astype(np.int64)].astype(float) * np.repeat(part, times), len(batch) * n).reshape(len(batch), n)
        shares = np.bincount(cell, minlength=len(batch) * n).reshape(len(batch), n) > 0
        score = np.round(score, 6)
        for q in range(n):
            own = np.flatnonzero(shares[:, q])
            if q in best and len(best[q][0]) == k:
                own = own[score[own, q] >= best[q][0][-1]]
            if not len(own):
                continue
            values, keys = score[own, q], batch.column("key").take(pa.array(own))
            if q in best:
                values, keys = np.concatenate([best[q][0], values]), pa.concat_arrays([best[q][1], keys])
            top = np.lexsort((np.array(keys.to_pylist()), -values))[:k]
            best[q] = (values[top], keys.take(pa.array(top)))
    for q, (values, keys) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), q), pa.int32()), keys, pa.array(values)], names=["q", "key", "score"])
