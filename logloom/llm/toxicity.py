"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

Fit, on a bounded sample of labelled documents (``per_class`` toxic ones, twice as many others, by a hash of
doc_id, and about ``most_bytes`` of text):
log-odds between the classes of each word and of each word beginning (3 to 8 letters), by the documents that hold it,
under nested Dirichlet priors: a form's prior counts (``PRIOR`` documents) are split as its next shorter form's, the
shortest form's as all documents. A token takes the log-odds of its longest form that departs from the base rate
(signed root of the likelihood ratio at least ``Z``); all others, and a token counted ``NEAR`` tokens ago or less,
which is no new evidence, cost ``DRIFT``. All maximal scoring segments of a text are found in one linear scan (Ruzzo and
Tompa). Under the clean token frequencies a best segment follows an extreme-value law: the chance to see score S among
n tokens is 1 - exp(-K n exp(-lambda S)), with lambda the root of the moment equation and K matched to the clean
sample. Segments with log E below 0 are significant; a logistic curve over the best segment's log E, the number of
significant segments and their excess gives the score, corrected for the rates of the sample. The curve and K are
fitted on segments of documents whose own words were left out (``FOLDS`` parts, copies of a text in the same one).

Edge cases: null and empty texts have no tokens and get the score of no evidence; without labels of both classes all
scores are the rate of toxic labels, or 0; repeated rows score alike; rows without a ``doc_id`` are scored, but not learned
from. Columns of the input named like an output are replaced, others pass through. Only text is an input of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

PER_CLASS, MOST_BYTES, PRIOR, Z, DRIFT, NEAR, FOLDS = 2000, 128_000_000, 2.0, 3.0, -0.08, 50, 4
TOKEN = re.compile(r"[^\W\d_]+")


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of a text of which ``scores`` lists the tokens that do
    not cost ``drift``, by position."""
    out: list[list] = []  # [left sum, right sum, first, last, place of the last one before of a smaller left sum]
    total, last = 0.0, -1
    for at, s in scores:
        total += drift * (at - last - 1)
        last = at
        before, total = total, total + s
        if s <= 0:
            continue
        first, j = at, len(out) - 1
        # What lies between a segment and its own predecessor has no smaller left sum, so it is passed over.
        while j >= 0 and out[j][0] >= before:
            j = out[j][4]
        while j >= 0 and out[j][1] < total:
            before, _, first, _, above = out[j]
            del out[j:]
            j = above
        out.append([before, total, first, at, j])
    return [(r - a, i, k) for a, r, i, k, _ in out]


def forms(word: str) -> list[str]:
    """The beginnings of a word and the word itself as keys of the model, shortest first."""
    return [*(word[:k] + "*" for k in range(3, min(9, len(word) + 1))), word]


class Odds(dict):
    """Log-odds of each word seen so far, None for a word that only costs the drift."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float | None:
        if len(self) > 500_000:
            self.clear()
        self[word] = next((self.known[f] for f in reversed(forms(word)) if f in self.known), None)
        return self[word]

    def __reduce__(self):
        return Odds, (self.known,)


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def marked(tokens: list[str], odds: Odds) -> list[tuple[int, float]]:
    """Places and log-odds of the tokens that do not cost the drift."""
    out, last = [], {}
    for i, t in enumerate(tokens):
        s = odds[t]
        if s is not None:
            if i - last.get(t, -NEAR - 1) > NEAR:
                out.append((i, s))
                last[t] = i
    return out


def evidence(tokens: list[str], model: dict) -> tuple[list[float], list[tuple[float, int, int]]]:
    """Features of a text, and its significant segments."""
    found = segments(marked(tokens, model["odds"]), DRIFT)
    level = math.log(model["k"] * max(1, len(tokens)))
    sure = [x for x in found if model["lambda"] * x[0] > level]
    best = max((x[0] for x in found), default=0.0)
    excess = sum(model["lambda"] * x[0] - level for x in sure)
    return [min(30.0, max(-30.0, model["lambda"] * best - level)), math.log1p(len(sure)), math.log1p(excess)], sure


def form_counts(rows: list[tuple[int, list[str]]], fold: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Forms, shorter ones first along a word, each one's next shorter form (a place in the list), and the counts of
    documents that hold it by fold and class. At place 0, the empty form, the distinct words of documents are counted."""
    place, above, chain = {"": 0}, [0], {}
    held = []
    for _, tokens in rows:
        own = set(tokens)
        for w in own:
            if w in chain:
                continue
            last, ids = 0, []
            for f in forms(w):
                if f not in place:
                    place[f] = len(above)
                    above.append(last)
                last = place[f]
                ids.append(last)
            chain[w] = np.array(ids, np.int32)
        held.append((len(own), np.unique(np.concatenate([np.empty(0, np.int32), *(chain[w] for w in own)]))))
    counts = np.zeros((FOLDS, 2, len(above)), np.int64)
    for (label, _), f, (n, ids) in zip(rows, fold, held):
        counts[f, label, ids] += 1
        counts[f, label, 0] += n
    return list(place), np.array(above), counts


def learn_odds(names: list[str], above: np.ndarray, counts: np.ndarray) -> Odds:
    """From ``counts`` by class; forms of one document say no more than shorter ones and are left out."""
    n0, n1 = counts[:, 0] + 1.0
    base = n1 / (n0 + n1)
    share, total = np.full(len(names), base), counts.sum(axis=0)
    level = np.array([0] + [len(f) if f[-1] == "*" else 99 for f in names[1:]])
    for size in np.unique(level[1:]):
        at = np.flatnonzero((level == size) & (total > 1))
        share[at] = (counts[1, at] + PRIOR * share[above[at]]) / (total[at] + PRIOR)
    at = np.flatnonzero((level > 0) & (total > 1))
    p, n = share[at], total[at] + PRIOR
    sure = 2 * n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base))) >= Z * Z
    odds = np.log(p / (1 - p)) - math.log(base / (1 - base))
    return Odds({names[i]: s for i, s in zip(at[sure].tolist(), odds[sure].tolist())})


def law(odds: Odds, clean: list[list[str]]) -> float:
    """Lambda: the root of the moment equation under the clean documents' words."""
    words = Counter(w for tokens in clean for w in set(tokens))
    size = 1 + words.total()
    freq = [(c / size, odds[w]) for w, c in words.items() if odds[w] is not None]
    rest = 1 - sum(p for p, _ in freq)
    moment = lambda t: rest * math.exp(t * DRIFT) + sum(p * math.exp(min(50.0, t * s)) for p, s in freq) - 1
    lo, hi = 1e-3, 1.0
    while moment(hi) < 0 and hi < 16:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 0 else (lo, mid)
    return hi


def learn(rows: list[tuple[int, list[str]]], offset: float = 0.0) -> dict:
    """The model of (label, tokens) of documents of both classes; ``offset`` is added to the curve."""
    fold = [zlib.crc32(" ".join(t).encode()) % FOLDS for _, t in rows]
    names, above, counts = form_counts(rows, fold)
    odds = learn_odds(names, above, counts.sum(axis=0))
    apart = [learn_odds(names, above, counts.sum(axis=0) - counts[i]) for i in range(FOLDS)]
    model = {"odds": odds, "lambda": law(odds, [t for y, t in rows if not y]), "k": 1.0}
    best = [(max((s for s, _, _ in segments(marked(t, apart[f]), DRIFT)), default=0.0), len(t)) for (y, t), f in zip(rows, fold) if not y]
    if tops := sorted(s for s, _ in best if s > 0):
        x = tops[len(tops) // 2]
        share = min(0.99, sum(s >= x for s, _ in best) / len(best))
        model["k"] = max(1e-6, -math.log(1 - share) / (np.mean([max(1, k) for _, k in best]) * math.exp(-model["lambda"] * x)))
    y = np.array([r[0] for r in rows], float)
    x = np.array([[1.0, *evidence(t, model | {"odds": apart[f]})[0]] for (_, t), f in zip(rows, fold)])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    w[0] += offset
    return model | {"w": w.tolist(), "rate": None}


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> dict:
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    empty = {"odds": Odds({}), "lambda": 1.0, "k": 1.0, "w": [0.0] * 4, "rate": float(not n.get(0) and bool(n.get(1)))}
    if not n.get(0) or not n.get(1):
        return empty
    part = {y: min(1.0, per_class * (2 - y) / n[y]) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000))
    ids = known.filter(draw < F.when(F.col("toxic") == 1, math.ceil(1e6 * part[1])).otherwise(math.ceil(1e6 * part[0])))
    # The sample is bounded by per_class, whatever the tables hold, so its ids may be broadcast.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "doc_id", "text")
    rows = bounded(found, most_bytes).collect()
    rows = [(r["toxic"], tokens_of(r["text"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))]
    if not 0 < sum(y for y, _ in rows) < len(rows):
        return empty
    return learn(rows, math.log(part[0] / part[1]))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages`` (score, first and last token); these names replace columns."""
    w = model["w"]

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            score, passages = [], []
            for text in batch:
                x, sure = evidence(tokens_of(text.as_py()), model)
                z = w[0] + sum(a * b for a, b in zip(w[1:], x))
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if model["rate"] is None else model["rate"])
                passages.append([{"s": s, "first": a, "last": b} for s, a, b in sure])
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(
                passages, pa.list_(pa.struct([("s", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])))], ["score", "passages"])
    said = F.arrow_udf(work, "struct<score:double,passages:array<struct<s:double,first:bigint,last:bigint>>>")
    keep = [c for c in docs.columns if c not in ("score", "predicted", "passages")]
    return docs.select(*keep, said(F.col("text").cast("string")).alias("_said")).select(
        *keep, "_said.score", (F.col("_said.score") >= 0.5).cast("int").alias("predicted"), "_said.passages")
