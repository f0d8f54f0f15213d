"""Near-duplicates by tensored MinHash banding, with links confirmed on full shingle sets.

1. Words and shingles are hashed in Arrow batches. A document's set gets a 128-bit fingerprint; documents with the
   same set are one class and go on as one row, so copies cost nothing later.
2. Tensored banding: two collections of ``m`` hash groups (``HALF`` minhashes each) are computed, and the table keys
   are the pairs of a group of the first with one of the second. So m * m tables of 2 * HALF minhashes cost 2 * m * HALF
   minhashes. ``m`` follows from the threshold: a pair just at it is missed by both collections together with a chance
   below 1e-4. A group that no other document has can't be half of a shared key: those are dropped before any pair of
   groups is formed, so a document without near copies makes 2 * m narrow rows, not m * m.
3. In every table, rows of a key are linked to the smallest id of their salted part, and the parts to each other: stars,
   never all pairs. Each link of a star is checked on the full sets at once, before anything is grouped, so candidates
   that fail never join groups. The confirmed links give components.
4. A key whose rows lie in one component needs no more. Keys of three and more documents in several components are
   open: a member may be linked to another one that isn't the star's middle. Their documents go through an exact
   prefix-filtered join: in order of rising frequency, two sets at the threshold share one of the first
   n - ceil(t n) + 1 shingles of each, and this is one of the first n - ceil(2 t n / (1 + t)) + 1 of the smaller
   set. Documents that share such a shingle form groups; texts on one template that differ in more than the threshold
   allows share none, however many they are.
5. Within those groups members are compared on full sets, in blocks; a block pair is one unit of work and returns a
   spanning forest of its links. First each block of about ``FIRST`` members is compared with itself and with block 0,
   which is linear in the group; then all members outside the group's largest component are compared with each other
   and with the members inside, in blocks of about ``BLOCK``. So no pair is a row, and every pair is compared.
6. Components of all links, by star contraction; each class takes the component of its representative.

Edge cases: null or empty texts and texts without words have an empty set and stay alone; with fewer words than a
shingle the whole sequence is the one shingle; repeated rows are one class; a null ``doc_id`` belongs to the class
of its text, and stands alone with a null component if no row of it has an id; an empty table gives no rows. An id
stands for one text. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, few, release, shuffle_parts, with_group_totals

HALF, STAR, FIRST, BLOCK = 4, 256, 128, 512
_M = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
SPACES = (32, 9, 10, 11, 12, 13)
_BYTE[list(SPACES)] = 0
_SPACE = _BYTE == 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 32, (2, 2, 1024), dtype=np.uint32) | np.uint32(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; A-Z count as a-z."""
    b = np.frombuffer(data, np.uint8)
    gap = _SPACE[b]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1]))) if len(b) else np.empty(0, np.int64)
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    word = np.cumsum(np.concatenate(([0], np.diff(starts))))  # same as starts - starts[0]
    length = np.diff(np.append(starts, len(b)))
    place = np.arange(starts[0], len(b)) - np.repeat(word + starts[0], length)
    power = np.multiply.accumulate(np.full(int(length.max()), _STEP, np.uint64))
    w = mix(np.add.reduceat(_BYTE[b[starts[0]:]] * power[place], starts - starts[0]))
    if n < width:
        out = np.uint64(n)
        for i in range(n):
            out = out + w[i:i + 1] * _PLACES[width + i]
        return mix(out)
    out = w[:n - width + 1] * _PLACES[0]
    for i in range(1, width):
        out = out + w[i:n - width + 1 + i] * _PLACES[i]
    return np.unique(mix(out))


def group_keys(s: np.ndarray, m: int) -> np.ndarray:
    """2 * m keys of HALF minhashes each: first collection, then second. Keys of different places differ."""
    n = 2 * m * HALF
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    mins = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 512):
        h = (x[None, i:i + 512] ^ _SEEDS[0, 0, :n, None]) * _SEEDS[0, 1, :n, None]
        np.minimum(mins, h.min(axis=1), out=mins)
    key = np.arange(1, 2 * m + 1).astype(np.uint64)
    for i in range(HALF):
        key = mix(key * _STEP + mins[i::HALF])
    return key.view(np.int64)


def groups_for(threshold: int) -> int:
    """Groups of a collection."""
    hit = (threshold / 100) ** HALF
    return max(1, math.ceil(math.log(5e-5) / math.log(1 - hit))) if hit < 1 else 1


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text").cast(pa.large_binary()):
        yield x.as_py() or b""


def signatures(docs: DataFrame, width: int, m: int) -> DataFrame:
    """``doc_id, n_shingles, fp1, fp2, keys``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, fp, keys = [], [], []
            for data in _texts(batch):
                s = shingle_set(data, width)
                size.append(len(s))
                fp.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(group_keys(s, m) if len(s) else np.empty(0, np.int64))
            fp = np.array(fp, np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))],
                ["doc_id", "n_shingles", "fp1", "fp2", "keys"])
    return plain(docs).mapInArrow(work, "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sets(rows: DataFrame, width: int, more: str) -> DataFrame:
    """``doc_id, text`` and the columns of ``more`` (as DDL) to ``id``, those columns and ``s``, the sorted shingle set."""
    names = [c.split()[0] for c in more.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = [shingle_set(data, width).view(np.int64) for data in _texts(part)]
                ends = np.cumsum([0] + [len(k) for k in own]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("doc_id", *names)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *own])))], ["id", *names, "s"])
    return rows.select("doc_id", *names, "text").mapInArrow(work, f"id long, {more}, s array<long>")


def star_edges(rows: DataFrame, key: str) -> DataFrame:
    """Links ``(u, v)`` that join all ids of each key: to the least of a salted part, then the parts' least ids."""
    def star(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("low", F.first("doc_id").over(w))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_parts(rows))).cast("int")
    one = star(rows.withColumn("salt", salt), key, "salt")
    inner = one.filter("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    two = star(one.filter("doc_id = low").select(key, "doc_id"), key)
    return inner.unionByName(two.filter("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))).distinct()


def shared_counts(own: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``own`` with each of ``cols``."""
    if len(own) * len(cols) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in cols] for a in own], np.int64)
    values = np.concatenate([*own, *cols])
    owner = np.repeat(np.arange(len(own) + len(cols)), [len(x) for x in (*own, *cols)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(own), len(cols)), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(own) + len(cols), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += part[:len(own)] @ part[len(own):].T
    return np.rint(out).astype(np.int64)


def forest(ids: np.ndarray, side: np.ndarray, across: bool, own: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block or, if ``across``, between two blocks (side 0 and 1; one may be empty)."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if across else left
    if not len(left) or not len(right):
        return []
    a, b = [own[i] for i in left], [own[i] for i in right]
    both = shared_counts(a, b)
    whole = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
    x, y = np.nonzero(100 * both >= threshold * whole)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    for i, j in zip(left[x].tolist(), right[y].tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[p] = q
            out.append((int(ids[i]), int(ids[j])))
    return out


def links(members: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links ``(u, v)`` of each member's block ``b`` with its blocks ``partners``; also ``id, grp, s``."""
    dealt = members.withColumn("c", F.explode("partners")).select(
        "id", "grp", F.least("b", "c").alias("bi"), F.greatest("b", "c").alias("bj"), (F.col("b") > F.col("c")).cast("int").alias("side"), "s")
    parts = shuffle_parts(members)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, side, own = None, [], [], []

        def close() -> list[tuple[int, int]]:
            return forest(np.array(ids), np.array(side), key[1] != key[2], own, threshold) if len(ids) > 1 else []
        for batch in batches:
            out = []
            column = batch.column("s")
            values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, (one, *k, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "grp", "bi", "bj", "side")))):
                if k != key:
                    out += close()
                    key, ids, side, own = k, [], [], []
                ids.append(one)
                side.append(s)
                own.append(values[at[i]:at[i + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["u", "v"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], ["u", "v"])
    return dealt.repartition(parts, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj").mapInArrow(work, "u long, v long")


def confirmed(docs: DataFrame, edges: DataFrame, width: int, threshold: int) -> DataFrame:
    """The links ``(u, v)`` of ``edges`` (each v the middle of a star) that hold on full sets.

    A set is computed once and goes to each of its stars; only the middle's set is held while a star is read. A star of
    more than ``STAR`` members is dealt in parts, each with the middle.
    """
    parts = F.ceil(F.col("n") / STAR).cast("int")
    edges = with_group_totals(edges, ["v"], "u", n=("count", "u"))
    role = lambda part, k: F.struct(F.col("v").alias("star"), part.cast("int").alias("part"), F.lit(k).alias("role")).alias("r")
    roles = edges.select(F.col("u").alias("doc_id"), role(F.pmod(F.xxhash64("u"), parts), 1)).unionByName(
        edges.select("v", "n").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.col("v").alias("doc_id"), role(F.col("part"), 0)))
    roles = roles.groupBy("doc_id").agg(F.collect_list("r").alias("roles"))
    own = sets(plain(docs).join(roles, "doc_id"), width, "roles array<struct<star:long,part:int,role:int>>")
    dealt = own.withColumn("r", F.explode("roles")).select("id", "r.star", "r.part", "r.role", "s")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, middle = None, np.empty(0, np.uint64)
        for batch in batches:
            u, v = [], []
            column = batch.column("s")
            values, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            for i, (one, k, role) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "star", "role")))):
                s = values[at[i]:at[i + 1]]
                if role == 0:
                    if k != star:
                        star, middle = k, s.copy()
                    continue
                both = int((middle[np.minimum(np.searchsorted(middle, s), len(middle) - 1)] == s).sum()) if k == star and len(middle) else 0
                if 100 * both >= threshold * (len(s) + len(middle) - both) and both:
                    u.append(one)
                    v.append(k)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return dealt.repartition(shuffle_parts(docs), "star", "part").sortWithinPartitions("star", "part", "role").mapInArrow(work, "u long, v long")


def open_members(halves: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, comp`` of the documents under keys of at least three documents of several components.

    Only components with a link of ``edges`` that failed are looked at. ``halves``: doc_id, a, b (groups that others share).
    """
    end = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    failed = edges.join(end("u"), "u", "left").join(end("v"), "v", "left").select(
        "u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).filter("cu <> cv")
    ends = failed.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct().withColumn("end", F.lit(1))
    rows = few(halves.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "comp", F.coalesce("component", "doc_id")).drop("component").join(ends, "doc_id", "left").withColumn("end", F.coalesce("end", F.lit(0))), 5_000)
    # A component may be large: whether one of its members failed comes back to it in parts.
    rows = few(with_group_totals(rows, ["comp"], "doc_id", failed=("max", "end")).filter("failed = 1"), 5_000)
    rows = rows.select("doc_id", "comp", F.explode(table_keys()).alias("key"))
    totals = with_group_totals(rows, ["key"], "doc_id", n=("count", "doc_id"), lo=("min", "comp"), hi=("max", "comp"))
    return totals.filter("n >= 3 and lo < hi").select("doc_id", "comp").distinct()


def prefixes(own: DataFrame, threshold: int) -> DataFrame:
    """``doc_id, key``: the shingles of ``own`` (id, s) under which sets at the threshold must meet."""
    t = threshold / 100
    tokens = with_group_totals(own.select("id", F.explode("s").alias("key")), ["key"], "id", n=("count", "id"))
    ranked = tokens.filter("n > 1").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("k"))
    rows = own.select("id", F.size("s").alias("size")).join(ranked, "id")
    # Shingles of one document only come first and meet nothing: the prefix holds what is left of it.
    alone = F.col("size") - F.size("k")
    first = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9).cast("int") + 1 - alone
    rows = rows.withColumn("strong", first(2 * t / (1 + t))).filter(first(t) > 0)
    rows = rows.select(F.col("id").alias("doc_id"), "strong", F.posexplode(F.slice("k", F.lit(1), first(t))).alias("i", "k")).select(
        "doc_id", F.col("k.key").alias("key"), (F.col("i") < F.col("strong")).cast("int").alias("strong"))
    rows = with_group_totals(cut(rows), ["key"], "doc_id", n=("count", "doc_id"), strong_=("max", "strong"))
    return rows.filter("n > 1 and strong_ = 1").select("doc_id", "key")


def table_keys() -> Column:
    return F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a, b))))


def block_of(column: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(column)).cast("int")


def first_round(group: DataFrame) -> DataFrame:
    """Blocks of each group, to be compared with themselves and with block 0: ``id, grp, b, partners``."""
    b = F.col("b")
    return group.withColumn("b", block_of("blocks")).select("id", "grp", "b", F.when(b == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), b)).alias("partners"))


def second_round(group: DataFrame, known: DataFrame) -> DataFrame:
    """The comparisons still open in groups of several blocks: ``id, grp, b, partners``.

    Members outside the largest component of ``known`` (``id, component``) fill the first blocks, to be compared with
    all; those inside fill the others, to be compared with the first blocks only.
    """
    rows = cut(group.filter("blocks > 1").join(known, "id", "left").select("id", "grp", F.coalesce("component", "id").alias("comp")))
    rows = cut(with_group_totals(rows, ["grp", "comp"], "id", n=("count", "id")).withColumn("rank", F.struct("n", "comp")))
    rows = with_group_totals(rows, ["grp"], "id", top=("max", "rank"), total=("count", "id")).filter("total > top.n").select(
        "id", "grp", (F.col("comp") == F.col("top.comp")).alias("inside"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("n_in"),
        F.ceil((F.col("total") - F.col("top.n")) / BLOCK).cast("int").alias("n_out"))
    last = F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_in") + F.col("n_out")) - 1
    return rows.select("id", "grp", F.when(F.col("inside"), F.col("n_out") + block_of("n_in")).otherwise(block_of("n_out")).alias("b"), F.sequence(F.lit(0), last).alias("partners"))


def near_dedup(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``; linked if 100 * shared >= threshold * union."""
    m = groups_for(threshold)
    base = few(signatures(docs, width, m).withColumn("row", F.monotonically_increasing_id()), 20_000)
    classes = few(with_group_totals(base.filter("n_shingles > 0"), ["fp1", "fp2"], "row", rep=("min", "doc_id")).select(
        "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")), 20_000)

    release(docs.sparkSession)
    each = classes.filter("doc_id = rep").select("doc_id", F.posexplode("keys").alias("i", "key"))
    shared = with_group_totals(each, ["key"], "doc_id", lo=("min", "doc_id"), hi=("max", "doc_id")).filter("lo < hi")
    side = lambda on: F.collect_set(F.when(on, F.col("key")))
    halves = few(shared.groupBy("doc_id").agg(side(F.col("i") < m).alias("a"), side(F.col("i") >= m).alias("b")).filter("size(a) > 0 and size(b) > 0"), 5_000)
    edges = few(star_edges(halves.select("doc_id", F.explode(table_keys()).alias("key")), "key"), 100_000)
    release(docs.sparkSession)
    linked = few(components(confirmed(docs, edges, width, threshold)), 100_000)

    release(docs.sparkSession)
    members = few(open_members(halves, edges, linked), 50_000)
    if not members.isEmpty():
        own = cut(sets(plain(docs).join(members, "doc_id"), width, "comp long").dropDuplicates(["id"]))
        release(docs.sparkSession)
        group = components(star_edges(prefixes(own.select("id", "s"), threshold), "key")).select("id", F.col("component").alias("grp"))
        group = few(group.unionByName(group.select(F.col("grp").alias("id"), "grp")).distinct(), 100_000)
        group = with_group_totals(group, ["grp"], "id", n=("count", "id")).select("id", "grp", F.ceil(F.col("n") / FIRST).cast("int").alias("blocks"))
        group = few(group, 100_000)

        def joined(known: DataFrame, pairs: DataFrame) -> DataFrame:
            more = links(pairs.join(own.select("id", "s"), "id"), threshold)
            return few(components(known.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)), 100_000)
        release(docs.sparkSession)
        linked = joined(linked, first_round(group))
        if not group.filter("blocks > 1").isEmpty():
            linked = joined(linked, second_round(group, linked))
    known = classes.select("doc_id", "n_shingles", "rep").join(
        linked, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    empty = base.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
