"""Language by the nearest of several clustered centroids per language.

Letters (in lower case, all else as one space) give hashed n-grams of one to three characters; a document is the
normalised TF-IDF vector of its whole text. Each language has ``clusters`` centroids (spherical k-means over its
sample); the language of the centroid with the largest cosine wins, and the cosine is the score. A document whose
cosine is below its language's limit is too far from all centroids and rejected. As short texts are farther from any
centroid, the limit depends on how many different n-grams a document has: it is ``SLACK`` times the ``QUANTILE`` of the
cosines of pieces (first words and whole texts) with about as many, to centroids fitted without their documents.

The fit takes a bounded sample: about ``per_lang`` rows a language, by a hash of doc_id, of the rows that the caller
allows, and about ``most_bytes`` of text in all; its texts and the model (clusters x languages x ``DIM`` floats) are all that the driver holds.

Edge cases: null texts and texts without a letter are ``und``, score 0, rejected; empty tables give no rows; a table
without any labelled text makes every document ``und``; a null ``doc_id`` counts as held out; rows that repeat are each
predicted. Columns of the input named like an output are replaced, others pass through. Only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

DIM, PER_LANG, CLUSTERS, MOST_BYTES = 4096, 400, 3, 64_000_000
QUANTILE, SLACK, PIECES = 0.01, 0.7, (1, 2, 4, 8, 16, 32, 64, 128)
_letters: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """Whether a row is left out of the fit; one without an id always is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x30000)])
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters[np.minimum(c, 0x2FFFF)]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    h1 = c * np.uint32(0x9E3779B1)
    h2 = h1[:-1] * np.uint32(0x85EBCA6B) + h1[1:]
    h3 = h2[:-1] * np.uint32(0xC2B2AE35) + h1[2:]
    h = np.concatenate((h1, h2, h3))
    return np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIM)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical(own: np.ndarray, clusters: int, rng: np.random.Generator) -> np.ndarray:
    c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
    for _ in range(12):
        at = (own @ c.T).argmax(1)
        c = unit(np.array([own[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))]))
    return c


def limits(texts: list[str], own: np.ndarray, idf: np.ndarray, clusters: int) -> tuple[list[float], list[float]]:
    """Knots (log2 of the number of different n-grams) and the limit at each, not falling."""
    fold, rng, seen = np.arange(len(texts)) % 2, np.random.default_rng(7), []
    for f in (0, 1):
        others = own[fold != f] if (fold != f).any() else own
        c = spherical(others, clusters, rng)
        for text in (t for t, g in zip(texts, fold) if g == f):
            words = text.split()
            pieces = [" ".join(words[:k]) for k in PIECES if k < len(words)] + [text]
            counts = np.array([g for g in map(grams, pieces) if g is not None], np.float32)
            cos = (unit(np.log1p(counts) * idf) @ c.T).max(1)
            seen.append(np.stack((np.log2((counts > 0).sum(1)), cos), 1))
    size, cos = np.concatenate(seen).T
    at = np.round(size).astype(int)
    knots = sorted(set(at))
    return [float(k) for k in knots], list(map(float, np.minimum.accumulate([SLACK * np.quantile(cos[at == k], QUANTILE) for k in reversed(knots)])[::-1]))


def fit(docs: DataFrame, allowed: Column | None = None, per_lang: int = PER_LANG, clusters: int = CLUSTERS, most_bytes: int = MOST_BYTES) -> dict:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.lit(True) if allowed is None else allowed))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.lit(False)
    for lang, k in n.items():
        part = part | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < -(-1_000_000 * per_lang // k)))
    sample = sorted(((r["lang"], r["doc_id"] or 0, r["text"]) for r in bounded(rows.filter(part).select("lang", "doc_id", F.col("text").cast("string").alias("text")), most_bytes).collect()))
    langs = sorted({x[0] for x in sample})
    if not langs:
        return {"langs": [], "idf": np.zeros(DIM, np.float32), "centroids": np.zeros((0, DIM), np.float32), "owner": [], "limits": []}
    # One array of the driver, filled and then changed in place.
    x = np.empty((len(sample), DIM), np.float32)
    for i, (_, _, text) in enumerate(sample):
        x[i] = grams(text)
    idf = np.log((len(x) + 1) / (np.count_nonzero(x, axis=0) + 1)).astype(np.float32) + np.float32(0.1)
    np.log1p(x, out=x)
    x *= idf
    for rows in (x[i:i + 256] for i in range(0, len(x), 256)):
        rows[:] = unit(rows)
    name = np.array([s[0] for s in sample])
    rng, centroids, owner, least = np.random.default_rng(7), [], [], []
    for i, lang in enumerate(langs):
        own = x[name == lang]
        c = spherical(own, clusters, rng)
        centroids.append(c)
        owner += [i] * len(c)
        least.append(limits([r[2] for r in sample if r[0] == lang], own, idf, clusters))
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids).astype(np.float32), "owner": owner, "limits": least}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; these names replace columns of the input."""
    langs, owner = model["langs"], np.array(model["owner"], np.int64)

    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            name, score, rejected = [], [], []
            texts = batch.to_pylist()
            for i in range(0, len(texts), 256):
                counts = [grams(t) if t and langs else None for t in texts[i:i + 256]]
                some = [c for c in counts if c is not None]
                if some:
                    x = unit(np.log1p(np.array(some, np.float32)) * model["idf"])
                    cos = np.clip(x @ model["centroids"].T, 0, 1)
                    top, best = cos.argmax(1), cos.max(1)
                    size = np.log2([np.count_nonzero(c) for c in some])
                k = 0
                for c in counts:
                    if c is None:
                        name.append("und"), score.append(0.0), rejected.append(True)
                    else:
                        own = owner[top[k]]
                        name.append(langs[own]), score.append(float(best[k])), rejected.append(bool(best[k] < np.interp(size[k], *model["limits"][own])))
                        k += 1
            yield pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])
    said = F.arrow_udf(lang, "struct<lang_pred:string,score:double,rejected:boolean>")
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*keep, said(F.col("text").cast("string")).alias("_said")).select(*keep, "_said.*")
