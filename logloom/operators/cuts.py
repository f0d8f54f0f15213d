"""Greedy cuts of sessions that are too long for one task.

Rows of a session have a position ``i`` from 1 and a running size ``S``. A piece that begins at row i ends before ``next(i)``,
the first row with which it would exceed a cap; that depends on the following ``max_events`` rows only. So each block of rows
finds the next cut of each of its rows, and with it, for each of the first ``max_events`` rows at which a piece may begin in
the block, where the first piece of the following block begins then. These short maps are composed over ever larger ranges
of blocks, ``FAN`` at a time, and read back from the top: every block learns where its first piece begins and cuts by itself.
No task holds more than a block, or ``FAN`` maps, of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Rows of a block, and maps that are composed at a time.
BLOCK, FAN = 4096, 64


def next_cuts(rows: DataFrame, session: list[str], max_chars: int, max_events: int, block: int) -> DataFrame:
    """``session, b, i, to``: the next cut of a piece that begins at each row. ``rows``: session, i, chars, total (up to i).

    The last row that still fits is the last whose total is not above the cap: both kinds of marks are sorted together.
    """
    b = F.floor((F.col("i") - 1) / block)
    # The first rows of a block are looked at by the block before, too.
    seen = F.when(((F.col("i") - 1) % block < max_events) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    marks = F.array(F.struct(F.col("total").alias("at"), F.lit(0).alias("kind"), F.lit(True).alias("any")), F.struct((F.col("total") - F.col("chars") + max_chars).alias("at"), F.lit(1).alias("kind"), F.lit(False).alias("any")))
    rows = rows.select(*session, "i", b.alias("own"), F.explode(seen).alias("b"), marks.alias("m")).select(*session, "i", "own", "b", F.explode("m").alias("m"))
    rows = rows.filter(F.col("m.any") | (F.col("own") == F.col("b")))
    order = Window.partitionBy(*session, "b").orderBy("m.at", "m.kind", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("m.kind") == 0, F.col("i"))).over(order)
    rows = rows.withColumn("last", last).filter(F.col("m.kind") == 1)
    return rows.select(*session, "b", "i", F.greatest(F.col("i") + 1, F.least(F.col("i") + max_events, F.coalesce(F.col("last"), F.lit(0)) + 1)).alias("to"))


def _maps(blocks: DataFrame, session: list[str], max_events: int, block: int) -> DataFrame:
    """``session, b, f``: for each row of a block at which a piece may begin, by its place, that of the next block's first."""
    # From the last row to the first; the exits of the rows just seen are at hand.
    exits = F.aggregate(F.reverse("to"), F.struct(F.expr("array()").cast("array<long>").alias("near"), F.size("to").cast("long").alias("at")), lambda s, to: F.struct(
        F.slice(F.concat(F.array(F.when(to - F.col("start") >= F.col("rows"), to).otherwise(F.get(s["near"], (to - F.col("start") - s["at"]).cast("int")))), s["near"]), 1, max_events).alias("near"),
        (s["at"] - 1).alias("at")))
    f = F.transform(exits["near"], lambda to: (to - F.col("start") - F.col("rows")).cast("int"))
    return blocks.withColumns({"start": F.col("b") * block + 1, "rows": F.size("to").cast("long")}).select(*session, "b", f.alias("f"))


def _entries(maps: DataFrame, session: list[str]) -> DataFrame:
    """``session, b, e``: the place in each block at which its first piece begins."""
    levels = [cut(maps)]
    while not levels[-1].filter("b > 0").isEmpty():
        grouped = levels[-1].groupBy(*session, F.floor(F.col("b") / FAN).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "f"))).alias("m"))
        own = F.transform("m", lambda m: m["f"])
        whole = F.aggregate(F.slice(own, 2, FAN), F.get(own, 0), lambda f, g: F.transform(f, lambda e: F.get(g, e)))
        levels.append(cut(grouped.select(*session, "b", whole.alias("f"))))
    known = levels[-1].select(*session, "b", F.lit(0).alias("e"))
    for below in reversed(levels[:-1]):
        grouped = below.groupBy(*session, F.floor(F.col("b") / FAN).alias("above")).agg(F.array_sort(F.collect_list(F.struct("b", "f"))).alias("m"))
        rows = grouped.join(known.withColumnRenamed("b", "above"), [*session, "above"])
        at = F.aggregate("m", F.array("e"), lambda seen, m: F.concat(seen, F.array(F.get(m["f"], F.element_at(seen, -1)))))
        rows = rows.select(*session, F.explode(F.arrays_zip(F.transform("m", lambda m: m["b"]).alias("b"), F.slice(at, F.lit(1), F.size("m")).alias("e"))).alias("x"))
        known = cut(rows.select(*session, F.col("x.b").alias("b"), F.col("x.e").alias("e")))
    return known


def pieces(rows: DataFrame, session: list[str], max_chars: int, max_events: int, block: int = BLOCK) -> DataFrame:
    """``rows`` (session, i, chars, total and more) with ``_piece``, the position of its piece's first row.

    Positions are gapless from 1, sizes are above 0. An empty table gives no rows.
    """
    block = max(block, max_events)
    steps = next_cuts(rows.select(*session, "i", "chars", "total"), session, max_chars, max_events, block)
    blocks = steps.groupBy(*session, "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda x: x["to"]).alias("to"))
    blocks = cut(blocks)
    entries = _entries(_maps(blocks, session, max_events, block), session)
    start = F.col("b") * block
    walked = F.aggregate("to", F.struct((start + F.col("e") + 1).alias("next"), (start + 1).alias("i"), F.expr("array()").cast("array<long>").alias("cuts")), lambda s, to: F.struct(
        F.when(s["i"] == s["next"], to).otherwise(s["next"]).alias("next"), (s["i"] + 1).alias("i"), F.when(s["i"] == s["next"], F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts")))
    cuts = blocks.join(entries, [*session, "b"]).select(*session, "b", walked["cuts"].alias("cuts"))
    # The last block may lie within a piece that began before it.
    past = Window.partitionBy(*session).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.try_element_at("cuts", F.lit(-1)), ignorenulls=True).over(past)
    cuts = cuts.withColumn("cuts", F.concat(F.when(before.isNotNull(), F.array(before)).otherwise(F.expr("array()").cast("array<long>")), "cuts"))
    # A piece is a range of rows of one block: the rows find it by the row that begins it, or their block's first.
    marks = cuts.select(*session, "b", F.explode("cuts").alias("_piece")).select(*session, "b", F.greatest("_piece", F.col("b") * block + 1).alias("i"), "_piece")
    marks = marks.groupBy(*session, "b", "i").agg(F.max("_piece").alias("_piece"))
    order = Window.partitionBy(*session, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("b", F.floor((F.col("i") - 1) / block)).join(marks, [*session, "b", "i"], "left")
    return marked.withColumn("_piece", F.max("_piece").over(order)).drop("b")
