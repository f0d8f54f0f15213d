"""JSON array files read by many tasks.

A file is split at closing braces, wherever it is split into blocks. What a brace means depends on all text before it: whether
a string is open, and how deep it stands. Both are sums. A fragment adds its number of quotes (those behind a backslash
not counted), and, for each of the two states it may begin in, the brackets outside of strings. Sums within a block are
running sums; blocks are joined by their totals, one row a block. A record ends where a brace outside of strings returns
to the depth of the array; what lies between two such braces is a few elements, which are parsed as an array of their own.

A file that is cut short, whose brackets don't match, or of which a part is no JSON has no records, as if it were parsed as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut


def _outside(text: Column, inside: bool) -> Column:
    """The brackets of a fragment outside of its strings, when it begins ``inside`` one or not."""
    text = F.regexp_replace(text, r"\\.", "")
    if inside:
        text = F.when(F.contains(text, F.lit('"')), F.regexp_replace(text, r'^[^"]*"', "")).otherwise("")
    return F.regexp_replace(F.regexp_replace(text, r'"[^"]*("|$)', ""), r"[^\[\]{}]", "")


def _depth(marks: Column) -> Column:
    """What the brackets add to the depth."""
    closing = F.length(F.regexp_replace(marks, r"[\[{]", ""))
    return F.length(marks) - 2 * closing


def _read(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))


def array_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file`` of those whose first mark is a bracket."""
    first = _read(spark, files).filter("block = 0").groupBy("file").agg(F.min_by(F.regexp_extract("text", r"^\s*(\S)", 1), "at").alias("mark"))
    return first.filter("mark = '['").select("file")


def fragments(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, block, at, text, open`` and the sums of each fragment: up to the next closing brace, which isn't in it."""
    rows = _read(spark, files)
    rows = rows.withColumn("quotes", F.length(F.regexp_replace(F.regexp_replace("text", r"\\.", ""), '[^"]', "")) % 2)
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)

    def step(start: int) -> Column:
        """The depth that the fragment and its brace add if its block begins in state ``start``."""
        inside = (F.col("odd") + start) % 2 == 1
        ends_inside = (F.col("odd") + F.col("quotes") + start) % 2 == 1
        return F.when(inside, _depth(_outside(F.col("text"), True))).otherwise(_depth(_outside(F.col("text"), False))) - F.when(ends_inside, 0).otherwise(1)
    return cut(rows.withColumns({"step0": step(0), "step1": step(1)}))


def elements(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, i, record``: the elements of each array as text, numbered from 1; a file that is no array has one row of nulls."""
    rows = fragments(spark, files)
    blocks = rows.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("step0").alias("d0"), F.sum("step1").alias("d1"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("q").over(past), F.lit(0)) % 2)
    blocks = blocks.withColumn("own", F.when(F.col("start") == 1, F.col("d1")).otherwise(F.col("d0")))
    blocks = blocks.select("file", "block", "start", F.coalesce(F.sum("own").over(past), F.lit(0)).alias("base"))
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(F.broadcast(blocks) if len(files) < 1000 else blocks, ["file", "block"]).withColumn("step", F.when(F.col("start") == 1, F.col("step1")).otherwise(F.col("step0")))
    rows = rows.withColumn("depth", F.col("base") + F.sum("step").over(here)).withColumn("outside", (F.col("odd") + F.col("quotes") + F.col("start")) % 2 == 0)
    rows = rows.withColumn("ends", (F.col("outside") & (F.col("depth") == 1)).cast("int"))
    # A record takes the number of records that ended before it.
    ended = rows.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    ended = ended.select("file", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("ended"))
    rows = rows.join(ended, ["file", "block"]).withColumn("k", F.col("ended") + F.sum("ends").over(here) - F.col("ends"))
    part = rows.groupBy("file", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x["text"]), "}").alias("text"), F.max("ends").alias("whole"))
    # The split left out the brace that ends a record; the last part ends with the array.
    text = F.when(F.col("whole") == 1, F.concat("text", F.lit("}"))).otherwise(F.regexp_replace("text", r"\][ \t\r\n]*$", ""))
    text = F.when(F.col("k") == 0, F.regexp_replace(text, r"^[ \t\r\n]*\[", "")).otherwise(F.regexp_replace(text, r"^[ \t\r\n]*,", ""))
    closed = (F.col("whole") == 1) | F.col("text").rlike(r"\][ \t\r\n]*$")
    last = F.col("whole") == 0
    empty = text.rlike(r"^[ \t\r\n]*$")
    # Only the end of the file, behind the last record, may hold nothing but the bracket.
    fits = F.when(last & (F.col("k") > 0), F.col("text").rlike(r"^[ \t\r\n]*(,|\])")).when(F.col("k") > 0, F.col("text").rlike(r"^[ \t\r\n]*,")).otherwise(F.col("text").rlike(r"^[ \t\r\n]*\["))
    none = F.expr("array()").cast("array<string>")
    part = part.select("file", "k", (closed & fits).alias("fits"), F.when(empty, none).otherwise(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")).alias("r"), empty.alias("empty"), last.alias("last"),
                       (F.col("text").rlike(r"^[ \t\r\n]*,") & empty).alias("comma"))
    part = part.withColumn("good", F.col("fits") & F.col("r").isNotNull() & ~F.col("comma"))
    part = cut(part)
    # One row a file: whether all its parts are JSON and its end is there.
    files_ok = part.groupBy("file").agg((F.every("good") & F.max("last")).alias("ok"))
    sizes = part.groupBy("file", (F.floor(F.col("k") / 10_000)).alias("run")).agg(F.sum(F.size("r")).alias("n"))
    sizes = sizes.select("file", "run", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    out = part.withColumn("run", F.floor(F.col("k") / 10_000)).withColumn("n", F.coalesce(F.sum(F.size("r")).over(within), F.lit(0))).join(sizes, ["file", "run"]).join(files_ok.filter("ok"), "file")
    out = out.select("file", F.col("base").alias("b"), "n", F.posexplode("r").alias("p", "record")).select("file", (F.col("b") + F.col("n") + F.col("p") + 1).cast("long").alias("i"), "record")
    return out.unionByName(files_ok.filter("not ok").select("file", F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("record")))
