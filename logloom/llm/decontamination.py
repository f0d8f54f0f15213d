"""Benchmark passages in documents, up to an edit budget, by the q-gram lemma over diagonal bands.

Texts are compared in lower case with white space as single spaces. An item of length L found with at most k edits
shares at least L + 1 - Q * (k + 1) of its q-grams with the document, all within k diagonals (document position minus
item position). Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half. A q-gram that repeats
within its item counts once for each of its places in all bands within its reach, so long runs of a mark are ranges of
bands, not pairs of places. Bands that reach the bound are kept, neighbours joined, and the item is aligned with the
document inside those diagonals only (semi-global); an item found without an edit is not aligned again. ``rate`` sets
k = floor(rate * L), less where the bound would fall under 1. Items shorter than Q are looked up word for word: no
letter or digit may stand directly before or after them, and an item without any is never found.

The index of the benchmark is built in slices of at most about ``slice_bytes`` of text: sizes are summed first, and
more slices are taken until none but single long items is above. Each slice is a broadcast of its own, of about 24
bytes a character. A pass of the documents uses at most ``a_pass`` slices; each worker holds one at a time, loads it
for a group of documents and lets it go. A larger benchmark takes more passes over the documents, which are then numbered
and written once; each pass writes its hits by row number and destroys its broadcasts, so what is broadcast at once stays
bounded whatever the size of the benchmark, and the texts move once more, in the join with the hits.

Edge cases: null or empty texts and items match nothing; items that repeat are each reported; an empty benchmark gives
no hits, an empty table no rows; rows that repeat and rows without a ``doc_id`` are scanned like others, as no id is
read; an item without an id counts as item 0. Columns of the input beside ``text`` pass through, but for one named
``hits``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

Q, RATE, SLICE, A_PASS = 12, 0.05, 2_000_000, 4
HIT = "array<struct<item_id:bigint,edits:int,begin:int,end:int>>"
WORD = re.compile(r"[^\W_]+")
#: Costs of what can't be reached, diagonals aligned at once, postings counted at once, and what an item's bands are told apart by.
FAR, PIECE, PAIRS, SHIFT = 1 << 29, 1 << 16, 1 << 20, 1 << 34
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def gram_hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < Q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        two = _STEP * _STEP
        four = two * two
        h2 = c[:-1] * _STEP + c[1:]
        h4 = h2[:-2] * two + h2[2:]
        h8 = h4[:-4] * four + h4[4:]
        h = h8[:-4] * four + h4[8:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def build(items: list[tuple[int, str]], rate: float = RATE) -> dict:
    items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
    length = np.array([len(t) for _, t in items], np.int64)
    budget = np.maximum(0, np.minimum((rate * length).astype(np.int64), (length - Q) // Q - 1))
    grams = [gram_hashes(t) for _, t in items]
    h = np.concatenate([np.empty(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])
    place = np.concatenate([np.empty(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in grams)])
    # One posting for each q-gram of an item: its first and last place there and how often it stands there.
    order = np.lexsort((place, item, h))
    h, item, place = h[order], item[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1 if len(first) else first
    short: dict[str, list[tuple[int, str, int]]] = {}
    for i, t in items:
        if len(t) < Q and (m := WORD.search(t)):
            short.setdefault(m[0], []).append((i, t, m.start()))
    known, start, count = np.unique(h[first], return_index=True, return_counts=True)
    seen = np.zeros(1 << 20, bool)
    seen[(known >> np.uint64(44)).astype(np.int64)] = True
    return {"items": items, "budget": budget, "bound": length + 1 - Q * (budget + 1), "reach": int((length + budget).max(initial=0)), "known": known, "start": start, "count": count,
            "short": short, "item": item[first], "low": place[first], "high": place[last], "times": (last - first + 1).astype(np.int32), "seen": seen}


def sweep(item: np.ndarray, doc: np.ndarray, low: int, row: np.ndarray, budget: int) -> np.ndarray | None:
    """Costs after the last symbol of ``item`` on the diagonals from ``low``; ``row`` are those before the first.

    None as soon as all costs are above ``budget``, as the least of them never falls.
    """
    width = len(row)
    step = np.arange(width, dtype=np.int32)
    # Place j of doc stands at j + pad; what is outside of doc is no symbol and can't be entered.
    pad = max(0, -low) + 1
    wide = np.full(pad + max(len(doc), len(item) + low + width) + 2, -1, np.int32)
    wide[pad:pad + len(doc)] = doc
    for i, c in enumerate(item.tolist()):
        at = i + low + pad
        own = wide[at:at + width]
        new = row + (own != c)
        new[own < 0] = FAR
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        # Outside of the document: diagonals left of place 0 and right of its end.
        left, right = max(0, -(i + 1 + low)), max(0, len(doc) - (i + low))
        new[:left], new[right:] = FAR, FAR
        row = np.minimum.accumulate(new - step) + step
        row[:left], row[right:] = FAR, FAR
        if row.min() > budget:
            return None
    return row


def align(item: str, doc: str, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best match of the whole item in the document on the ``width`` diagonals from ``low``.

    None if it takes more than ``budget`` edits. Wide ranges are taken in pieces that overlap by as much as an
    alignment can drift, so memory does not grow with the range.
    """
    at = doc.find(item, max(0, low), max(0, low + width) + len(item))
    if at >= 0:
        return 0, at, at + len(item)
    best, own = None, np.frombuffer(item.encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    for first in range(low, low + width, PIECE):
        found = align_piece(own, doc, first, min(PIECE + 2 * (budget + 1), low + width - first), budget)
        if found and (best is None or found[0] < best[0]):
            best, budget = found, found[0]
    return best


def align_piece(a: np.ndarray, doc: str, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    lo, hi = max(0, low), max(0, min(len(doc), low + width + len(a)))  # the piece's part of the document
    b, low = np.frombuffer(doc[lo:hi].encode("utf-32-le", "replace"), np.uint32).astype(np.int32), low - lo
    start = np.arange(low, low + width)
    row = sweep(a, b, low, np.where((start < 0) | (start > len(b)), FAR, 0).astype(np.int32), budget)
    if row is None:
        return None
    d = int(row.argmin())
    end = min(max(low + d + len(a), 0), len(b))
    # Backwards from that end: the diagonals near it mirrored, the end alone free.
    edits = int(row[d])
    left, right = max(0, d - edits), min(width, d + edits + 1)
    low, width = low + left, right - left
    low2 = -(low + width - 1) - len(a) + end
    places = np.arange(low2, low2 + width)
    back = sweep(a[::-1], b[:end][::-1], low2, np.where((places < 0) | (places > end), FAR, places).astype(np.int32), edits)
    best = int(back.argmin())
    return edits, lo + max(0, end - (low2 + best + len(a))), lo + end


def united(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of equal keys that meet or touch as one; within a key they come by ``low``."""
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    if not len(key):
        return key, low, high
    top = np.maximum.accumulate(high + key * SHIFT) - key * SHIFT  # the largest end so far within the key
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] > top[:-1] + 1)
    first = np.flatnonzero(new)
    return key[first], low[first], np.maximum.reduceat(high, first)


def bands(index: dict, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of bands (item, first, last) that reach their item's bound, by the places ``at`` of q-grams of the index.

    A q-gram of an item counts once for each of its places in every band that any of its diagonals lies in, however
    often it stands in the document. That is never less than the q-grams shared, and exact for those that stand in
    the item once.
    """
    n = index["count"][slot]
    posting = np.repeat(index["start"][slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    step = index["budget"][index["item"][posting]] + 1
    posting, low, high = united(posting, (at - index["high"][posting]) // step - 1, (at - index["low"][posting]) // step)
    item, times = index["item"][posting].astype(np.int64), index["times"][posting].astype(np.int64)
    key, which = np.unique(np.concatenate((item * SHIFT + low, item * SHIFT + high + 1)) + (SHIFT >> 1), return_inverse=True)
    shared = np.cumsum(np.bincount(which, np.concatenate((times, -times))).astype(np.int64))
    good = np.flatnonzero(shared[:-1] >= index["bound"][key[:-1] // SHIFT])
    item = key[good] // SHIFT
    return united(item, key[good] % SHIFT - (SHIFT >> 1), key[good + 1] % SHIFT - (SHIFT >> 1) - 1)


def stretches(index: dict, at: np.ndarray, slot: np.ndarray):
    """Parts of the places with about ``PAIRS`` postings each; a match of any item lies whole in one of them."""
    total = np.cumsum(index["count"][slot])
    first = 0
    while first < len(at):
        last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS)), int(np.searchsorted(at, at[first] + 2 * index["reach"])))
        yield slice(first, last)
        if last >= len(at):
            return
        first = max(first + 1, int(np.searchsorted(at, at[last] - index["reach"])))


def find(text: str | None, index: dict) -> list[dict]:
    doc = normal(text)
    out = []
    if index["short"]:
        first: dict[tuple[int, str], int] = {}
        for m in WORD.finditer(doc):
            for item_id, item, lead in index["short"].get(m[0], ()):
                at = m.start() - lead
                after = at + len(item)
                if at >= 0 and doc.startswith(item, at) and not (at and doc[at - 1].isalnum()) and not doc[after:after + 1].isalnum():
                    first.setdefault((item_id, item), at)
        for (item_id, item), at in first.items():
            out += [{"item_id": item_id, "edits": 0, "begin": at, "end": at + len(item)}] * sum(x[:2] == (item_id, item) for x in index["short"][WORD.search(item)[0]])
    h = gram_hashes(doc)
    if not len(h) or not len(index["known"]):
        return out
    at = np.flatnonzero(index["seen"][(h >> np.uint64(44)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(index["known"], h[at]), len(index["known"]) - 1)
    same = index["known"][slot] == h[at]
    at, slot = at[same], slot[same]
    if not len(at):
        return out
    item, low, high = united(*(np.concatenate(x) for x in zip(*(bands(index, at[part], slot[part]) for part in stretches(index, at, slot)))))
    best: dict[int, tuple[int, int, int]] = {}
    for k, b, e in zip(item.tolist(), low.tolist(), high.tolist()):
        step, limit = int(index["budget"][k]) + 1, best[k][0] - 1 if k in best else int(index["budget"][k])
        if limit >= 0 and (own := align(index["items"][k][1], doc, b * step, (e - b + 2) * step, limit)):
            best[k] = own
    return out + [{"item_id": index["items"][k][0], "edits": n, "begin": begin, "end": end} for k, (n, begin, end) in best.items()]


def hits(text: Column, slices: list) -> Column:
    """Hits of all ``slices``, which are broadcasts of an index each."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lone = slices[0].value if len(slices) == 1 else None
        for batch in batches:
            found: list[list[dict]] = [[] for _ in batch]
            for own in slices:
                index = lone or own.value
                for out, t in zip(found, batch):
                    out += find(t.as_py(), index)
                if lone is None:
                    del index
                    own.unpersist_local()
            yield pa.array(found, kind)
    # Deterministic in fact; said otherwise so that a filter on the hits does not scan each text a second time.
    return F.arrow_udf(work, HIT).asNondeterministic()(text.cast("string"))


class Slice:
    """A broadcast whose value a worker can let go and read again."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> dict:
        return self.broadcast.value

    def unpersist_local(self) -> None:
        self.broadcast.__dict__.pop("_value", None)


def sliced(items: DataFrame, slice_bytes: int) -> int:
    """A number of hash slices of which none holds several items and more than about ``slice_bytes``."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // slice_bytes))
    while n > 1:
        sizes = items.groupBy(part_of(n).alias("part")).agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("item_id", "text").alias("n"))
        if sizes.filter((F.col("size") > 2 * slice_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    return n


def part_of(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(n))


def indexes(items: DataFrame, n: int, parts: range, rate: float) -> list[Slice]:
    """The slices ``parts`` of ``n``, broadcast; the benchmark is read once for all of them."""
    own: dict[int, list] = {i: [] for i in parts}
    for r in items.withColumn("part", part_of(n)).filter(F.col("part").isin(list(parts))).collect():
        own[r["part"]].append((r["item_id"], r["text"]))
    return [Slice(items.sparkSession.sparkContext.broadcast(build(sorted(own[i]), rate))) for i in parts]


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE, a_pass: int = A_PASS) -> DataFrame:
    """``docs`` with ``hits``, the items found: item_id, edits, begin and end in the normalised text."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("text").cast("string").alias("text"))
    n = sliced(items, slice_bytes)
    if n <= a_pass:
        return docs.withColumn("hits", hits(F.col("text"), indexes(items, n, range(n), rate)))
    row, kept = "_row" + "_".join(["", *docs.columns]), [c for c in docs.columns if c.lower() != "hits"]
    numbered = cut(docs.select(*kept).withColumn(row, F.monotonically_increasing_id()))
    found = None
    for first in range(0, n, a_pass):
        slices = indexes(items, n, range(first, min(n, first + a_pass)), rate)
        own = cut(numbered.select(row, F.explode(hits(F.col("text"), slices)).alias("hit")))
        found = own if found is None else found.unionByName(own)
        for s in slices:  # the hits are written
            s.broadcast.destroy()
    by_row = found.groupBy(row).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return numbered.join(by_row, row, "left").select(*kept, F.coalesce("hits", F.array().cast(HIT)).alias("hits"))
