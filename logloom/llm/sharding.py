"""Shards by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks and shards. A row descends it: on each level every child of the chosen node draws
``ln(u) / weight`` with ``u`` hashed from the key and the child's name, and the largest draw wins. A node's weight is
the sum of what is below. A change of weights below one node moves rows only into or out of the subtrees whose
weights change; a new region takes rows only into itself, as no other draw changes. ``grow`` therefore adds capacity
as a region of its own.

Law ``key``: the key and the tree decide. Nothing is gathered: each row finds its shard alone.

Slots count the rows of a shard from 0 without gaps. They are numbered in 256 hash parts of each shard (of key, size and
checksum of the text, so that rows without a key spread), whose counts (shards x 256 rows, a bound that doesn't grow
with the data) are summed up and broadcast; a part is sorted by key. Texts are read once: what is numbered is a
checkpoint of narrow rows.

Edge cases: a null text has no bytes; keys are hashed as text, so integer types agree; a null key is a key like any
other; repeated rows go to the same shard and get
slots of their own; an empty table gives an empty result. Columns of the input beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PARTS = 256

Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]


def tree(n_shards: int, regions: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """Shards 0 to n - 1 dealt in equal runs over regions and racks; ``weights`` by shard, 1 if not given."""
    w = weights or {}
    cells = regions * racks
    bounds = [i * n_shards // cells for i in range(cells + 1)]
    out = []
    for r in range(regions):
        own = [(f"r{r}k{k}", [(s, float(w.get(s, 1.0))) for s in range(bounds[r * racks + k], bounds[r * racks + k + 1])]) for k in range(racks)]
        own = [(name, shards) for name, shards in own if shards]
        if own:
            out.append((f"r{r}", own))
    return out


def grow(old: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region; it takes rows only into itself."""
    return [*old, (f"r+{shard}", [(f"r+{shard}k0", [(shard, float(weight))])])]


def shard_of(key: Column, topology: Tree) -> Column:
    """The shard (int) to which a key descends."""
    if any(w <= 0 for _, racks in topology for _, shards in racks for _, w in shards):
        raise ValueError("weights must be positive")

    def node(name: str, weight: float) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(weight).alias("w"))

    def best(children: Column) -> Column:
        """Index from 1 of the child with the largest draw."""
        def draw(c: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + 0.5) * (2.0 ** -53)
            return F.log(u) / c["w"]
        return F.array_max(F.transform(children, lambda c, i: F.struct(draw(c).alias("d"), (i + 1).alias("i"))))["i"]

    total = lambda shards: sum(w for _, w in shards)
    regions = F.array(*(node(r, sum(total(s) for _, s in racks)) for r, racks in topology))
    racks = F.array(*(F.array(*(node(k, total(s)) for k, s in racks)) for _, racks in topology))
    shards = F.array(*(F.array(*(F.array(*(node(f"s{i}", w) for i, w in s)) for _, s in racks)) for _, racks in topology))
    numbers = F.array(*(F.array(*(F.array(*(F.lit(i) for i, _ in s)) for _, s in racks)) for _, racks in topology))
    at = lambda a, i: F.element_at(a, i)
    one = F.array(best(regions))
    two = F.transform(one, lambda r: F.struct(r.alias("r"), best(at(racks, r)).alias("k")))
    three = F.transform(two, lambda x: at(at(at(numbers, x["r"]), x["k"]), best(at(at(shards, x["r"]), x["k"]))))
    return F.element_at(three, 1).cast("int")


def shard(docs: DataFrame, topology: Tree, grown: Tree | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot`` and ``grown_shard``, the shard under ``grown``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("string")
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, topology).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), key, "text_crc32", "size"), F.lit(PARTS)).cast("int")))
    counts = rows.groupBy("shard", "part").count()
    before = counts.select("shard", "part", F.coalesce(
        F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("rank", rank)
    return numbered.join(F.broadcast(before), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
