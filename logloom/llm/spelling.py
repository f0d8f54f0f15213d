"""Groups of spellings: words one inserted, deleted or replaced code point apart, and the common form of each.

The join is an even-partition pigeonhole join. A word of length l is indexed under its two halves. One edit leaves one of
them whole, so a word of length l or l + 1 finds it by two substrings of its own, the second shifted by the difference of
the lengths. A candidate that both halves give is kept for the first alone, then verified by a banded edit distance.

A half that very many words share would make all pairs of them. Where more than ``crowd`` words stand under a half, its
rows are not joined: the other half, in which the edit must lie, is halved again by the same rule, and so on. What is left
at the end is a window of one code point, under which stand no more words than the alphabet has letters.

Null texts have no words and null ids count as the empty string. Long texts are read whole and long words stay whole.
Repeated rows count again. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: One in so many runs loses a letter.
DAMAGED = 199
#: A form is at least so many times as frequent.
RATIO = 5


def words(docs: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n`` over all texts. A run shorter than ``shortest`` gives no word, as a run only loses letters."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = F.pmod(F.col("h"), size).cast("int")
    spelt = F.when(F.col("h") % DAMAGED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    rows = rows.withColumn("h", h).select(spelt.alias("word")).filter(F.length("word") >= shortest)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _key(shift: Column) -> Column:
    """What stands outside of the window, with the window's place."""
    rest = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("\n"), F.substring("word", F.col("b") + shift + 1, F.length("word")))
    return F.xxhash64("l", "a", "b", rest)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for each half of its window [a, b); the key is what stands outside of that half."""
    middle = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2).cast("int")
    parts = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    rows = rows.withColumn("part", F.explode(parts)).withColumn("a", F.col("part.a")).withColumn("b", F.col("part.b")).drop("part")
    return rows.withColumn("key", _key(F.col("shift")))


def near(counted: DataFrame, crowd: int = 64) -> DataFrame:
    """``word, n, other, other_n`` for each ordered pair of ``counted`` (word, n; words once) that is one edit apart.

    A word is indexed at its own length (``shift`` null) and asks for words of its length (0) and of one less (1).
    """
    rows = counted.select("word", "n", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("role"))
    rows = rows.select("word", "n", "role", F.greatest("role", F.lit(0)).alias("shift"), (F.length("word") - F.greatest("role", F.lit(0))).cast("int").alias("l"))
    rows = rows.withColumns({"a": F.lit(0), "b": F.col("l")})
    found = None
    while True:
        rows = cut(_halves(rows))
        # Only as many keys as there are crowds are looked at again.
        sizes = rows.filter("role = -1").groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("b") - F.col("a")).alias("width"))
        crowds = cut(sizes.filter((F.col("size") > crowd) & (F.col("width") > 1)).select("key"))
        crowded = not crowds.isEmpty()
        calm = rows.join(crowds, "key", "left_anti") if crowded else rows
        pairs = _verified(calm)
        found = pairs if found is None else found.unionByName(pairs)
        if not crowded:
            return found
        rows = rows.join(crowds, "key", "left_semi").drop("key")


def _verified(rows: DataFrame) -> DataFrame:
    """Candidates of one round: each pair once, then by its edit distance, then in both directions."""
    index = rows.filter("role = -1").select("key", F.col("word").alias("r"), F.col("n").alias("rn"))
    probe = rows.filter("role >= 0").select("key", "shift", "l", "a", "b", F.col("word").alias("s"), F.col("n").alias("sn"))
    pairs = index.join(probe, "key").filter((F.length("r") == F.col("l")) & ((F.col("shift") == 1) | (F.col("r") < F.col("s"))))
    # A letter inserted before the window's first place too is found under the half before.
    again = (F.col("shift") == 1) & (F.col("a") > 0) & (F.substring("s", F.col("a") + 2, F.length("s")) == F.substring("r", F.col("a") + 1, F.length("r")))
    pairs = pairs.filter(~again).filter(F.levenshtein("r", "s", 1) == 1)
    both = F.array(F.struct(F.col("r").alias("word"), F.col("rn").alias("n"), F.col("s").alias("other"), F.col("sn").alias("other_n")),
                   F.struct(F.col("s").alias("word"), F.col("sn").alias("n"), F.col("r").alias("other"), F.col("rn").alias("other_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def forms(counted: DataFrame, crowd: int = 64) -> DataFrame:
    """``word, n, n_near, form, form_n`` for each word. Only counts and the best so far move, combined on the map side."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    seen = near(counted, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = counted.join(seen, "word", "left").withColumn("form_n", -F.col("best.less"))
    far = F.col("form_n") >= RATIO * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """``rows`` (word, form) with ``root``: the end of the forms that follow each other, by pointer doubling.

    Each form is ``RATIO`` times as frequent as its word, so 28 steps, which 5 doublings exceed, are the longest way
    that 64-bit counts allow.
    """
    way = cut(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return rows.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, crowd: int = 64) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs``."""
    return with_roots(cut(forms(cut(words(docs)), crowd))).select("word", "form", "root", "n", "n_near", "form_n")
