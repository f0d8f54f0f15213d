import random

from pyspark.sql import functions as F
from pyspark.sql import Window

from logloom.operators import cuts


def test_cuts_of_any_block_size(spark):
    """Sessions of all lengths against the rule read row by row; blocks as small as a piece, and maps over three levels."""
    draw, rows, want = random.Random(7), [], {}
    for s in range(8):
        n, total, chars, held, first = draw.choice([1, 5, 6, 7, 60, 700, 1500]), 0, 0, 0, 1
        for i in range(1, n + 1):
            size = draw.choice([1, 5, 40, 90, 200])
            total += size
            if held and (chars + size > 120 or held >= 5):
                chars, held, first = 0, 0, i
            chars, held = chars + size, held + 1
            rows.append((s, i, size, total))
            want[s, i] = first
    df = spark.createDataFrame(rows, "s int, i long, chars long, total long").repartition(4)
    for block in (5, 6, 64, 4096):
        got = cuts.pieces(df, ["s"], 120, 5, block)
        assert {(r.s, r.i): r["_piece"] for r in got.collect()} == want and got.count() == len(rows)
    assert cuts.pieces(df.limit(0), ["s"], 120, 5).count() == 0


def test_a_session_is_many_tasks(spark):
    """No group that the plan forms holds more than a block and what it looks ahead."""
    n = 40_000
    df = spark.range(1, n + 1).select(F.lit("one").alias("s"), F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("chars")).withColumn("total", F.sum("chars").over(Window.orderBy("i")))
    steps = cuts.next_cuts(df, ["s"], 100, 20, 1000)
    assert steps.groupBy("b").count().agg(F.max("count")).first()[0] == 1000 and steps.count() == n
    pieces = cuts.pieces(df, ["s"], 100, 20, 1000).groupBy("_piece").agg(F.sum("chars").alias("c"), F.count("*").alias("n"), F.min("i").alias("first"))
    assert pieces.filter("c > 100 or n > 20 or first <> _piece").count() == 0
    # Greedy: each piece and the next one's first row would exceed a cap.
    after = pieces.withColumn("next", F.lead("_piece").over(Window.orderBy("_piece"))).filter("next is not null and n < 20").select((F.col("c") + F.col("next") % 7 + 1).alias("c"))
    assert after.filter("c <= 100").count() == 0
