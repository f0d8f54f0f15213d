"""Mixing sources to target weights by the cube method.

Every document of a source has the same inclusion ratio, the source's target over its size: its whole part is taken
for sure, its fraction is an inclusion probability. The flight phase of the cube method settles the probabilities
without changing the source's expected words and expected number of documents: of three open documents a vector in
the null-space of both constraints is followed until one of them reaches 0 or 1, forwards or backwards with chances
that keep each document's probability. Documents come in by falling size, so the at most two that stay open are small.

At scale the flight runs on blocks of about ``BLOCK`` documents of a source, dealt by a hash of the document; what
stays open (at most two a block) is dealt anew, with its current probabilities, until a source is one block. Only
there the landing phase rounds the one or two documents left, to the words nearest to the target, and a few exchanges
of a taken with an untaken document of the block cancel what that rounding costs. If a source does not settle in
``ROUNDS`` rounds (blocks of one or two documents), an error is raised.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share`` of all words; a target stops
at twice its source's words and the rest is shared again by weight (the water level, found with running sums).

Edge cases: a null text has no words; a source without words has target 0; a null source is a source; rows that
repeat are documents of their own; rows without a ``doc_id`` are told apart by their text; an empty table gives no rows. Draws depend on source, block and the sorted
documents of a block, so reruns agree whatever the partitions. Columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, ROUNDS, EXCHANGES = 4096, 20, 10
WEIGHTS = (5, 2, 1)
#: Stands for a missing doc_id while rows are in pandas, where a null would turn ids into floats.
NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"
STATE = "doc_id long, t long, size long, skey string, source_size long, target double, whole int, p double, blocks int"


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1."""
    p, z = p.tolist(), size.tolist()
    todo = [i for i, x in enumerate(p) if 0 < x < 1][::-1]
    held: list[int] = []
    k = 0
    while True:
        while todo and len(held) < 3:
            held.append(todo.pop())
        if len(held) < 3:
            if len(held) == 2 and z[held[0]] == z[held[1]]:
                u = (1, -1)
            else:
                break
        else:
            a, b, c = held
            u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
            if not any(u):
                u = (1, -1, 0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for i, x in zip(held, u):
            if x:
                q = p[i] + step * x
                p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The open documents rounded so that words, then documents, are nearest to what is expected."""
    left = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    best = min(range(1 << len(left)), key=lambda bits: (
        abs(sum(size[i] * ((bits >> j & 1) - p[i]) for j, i in enumerate(left))), abs(sum((bits >> j & 1) - p[i] for j, i in enumerate(left))), bits))
    for j, i in enumerate(left):
        out[i] = best >> j & 1
    return out


def repaired(size: np.ndarray, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` with the one exchange of a taken and an untaken document (either may be none) that best cancels the error."""
    excess = float(np.sum(size * (x - start)))
    free = (start > 0) & (start < 1)
    ones, zeros = np.flatnonzero(free & (x == 1)), np.flatnonzero(free & (x == 0))
    zeros = zeros[np.argsort(size[zeros], kind="stable")]
    give, have = np.append(size[ones], 0.0), np.append(0.0, size[zeros])  # place 0 of have and the end of give: none
    order = np.argsort(have, kind="stable")
    at = np.searchsorted(have[order], give - excess)
    best = (abs(excess), -1, -1)
    for near in (np.clip(at - 1, 0, len(have) - 1), np.clip(at, 0, len(have) - 1)):
        error = np.abs(excess - give + have[order[near]])
        k = int(np.argmin(error))
        if error[k] < best[0]:
            best = (float(error[k]), k, int(order[near[k]]))
    out = x.copy()
    if best[1] >= 0:
        if best[1] < len(ones):
            out[ones[best[1]]] = 0
        if best[2] > 0:
            out[zeros[best[2] - 1]] = 1
    return out


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "h", "doc_id", "t"], ascending=[False, True, True, True], kind="stable")
    size, start = rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64)
    seed = zlib.crc32(f"{rows['skey'].iloc[0]}|{int(rows['block'].iloc[0])}|{int(rows['blocks'].iloc[0])}".encode())
    p = flight(size, start, np.random.Generator(np.random.PCG64(seed)).random(len(start) + 1))
    if rows["blocks"].iloc[0] == 1:
        p = landing(size, p)
        for _ in range(EXCHANGES):
            p, before = repaired(size, start, p), p
            if np.array_equal(p, before):
                break
    return rows.assign(p=p)[[c.split()[0] for c in STATE.split(", ")]]


def targets(sized: DataFrame, share: float, cap: float) -> DataFrame:
    """Per source ``skey, source_size, target, n``."""
    by = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS)))
    by = by.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), turn + 1)).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(full) - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / (
        F.sum("w").over(full) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("holds", F.col("level") <= F.col("most") / F.col("w"))
    water = F.coalesce(F.min(F.when(F.col("holds"), F.struct(F.col("most") / F.col("w"), "skey", "level"))).over(full)["level"], F.lit(float("inf")))
    return by.select("skey", "source_size", "n", F.least("most", F.col("w") * water).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` and ``copies``, how often the mix takes it."""
    sized = cut(docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sized.drop("source").join(targets(sized, share, cap), "skey").withColumn("r", F.round(ratio, 12)).select(
        "doc_id", "t", "size", "skey", "source_size", "target", F.floor("r").cast("int").alias("whole"), (F.col("r") - F.floor("r")).alias("p"),
        F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("blocks"))
    done = []
    for round_ in range(ROUNDS):
        h = F.xxhash64(F.lit(round_), "doc_id", "t")
        # One key for source and block: rows dealt by source alone, for the join above, must be dealt anew.
        dealt = state.withColumn("h", h).withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("int")).withColumn("cell", F.concat_ws("|", "block", "skey"))
        now = cut(dealt.groupBy("cell").applyInPandas(_settle, STATE))
        done.append(now.filter("p = 0 or p = 1"))
        left = now.filter("p > 0 and p < 1")
        if left.isEmpty():
            break
        n = left.groupBy("skey").agg(F.count("*").alias("n"))
        if round_ == ROUNDS - 1:
            raise RuntimeError(f"{left.count()} documents are still open after {ROUNDS} rounds; take larger blocks than {block}")
        state = left.drop("blocks").join(n, "skey").select(
            "doc_id", "t", "size", "skey", "source_size", "target", "whole", "p", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("int")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))
