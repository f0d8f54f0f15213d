"""Exact duplicates by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own characters say so: after ``MIN`` code points at the first place where three
neighbouring characters fall into three given classes, at ``MAX`` at the latest. The recipe of a document is the
ordered list of its chunks' identifiers. An identifier is the chunk's 64-bit hash, verified: every distinct
(hash, chunk) pair is gathered once, combined on the map side, and a hash that stands for several chunks gets a
number for each of them, so equal recipes mean equal texts. Then only the narrow recipes are compared; the long
texts move once, as distinct chunks, and never with their documents.

Edge cases: a null text counts as empty; an empty text has the empty recipe; a null ``doc_id`` stays a row of its
group (the largest id that is not null is kept). Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_group_totals

MIN, MAX = 253, 4093
#: Code points whose number leaves a given rest modulo 8, over ASCII and Latin-1: about one in eight of any text.
CLASSES = tuple("".join(f"\\u{c:04X}" for c in range(32, 256) if c % 8 == rest) for rest in (1, 4, 5))
CUT = f"(?s).{{{MIN},{MAX}}}?(?:[{CLASSES[0]}][{CLASSES[1]}][{CLASSES[2]}]|\\z)|.{{{MAX}}}|.+"


def chunks(text: Column) -> Column:
    """Pieces whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``doc_id``, ``text_sha256`` and ``recipe``, the ordered list of verified chunk identifiers."""
    def mark(c: Column) -> Column:
        return F.xxhash64(c) if hash_bits >= 64 else F.pmod(F.xxhash64(c), F.lit(1 << hash_bits))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = cut(plain.select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), mark).alias("recipe")))
    piece = plain.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(mark(F.col("chunk")).alias("h"), "chunk")
    known = piece.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clash = known.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    if clash.isEmpty():
        return rows
    # Hashes that stand for several chunks: number the chunks and put (number) into the lists that hold them.
    table = known.join(clash, "h").select(
        "h", F.xxhash64(F.lit("again"), "chunk").alias("h2"), F.sha2("chunk", 256).alias("sha"))
    placed = plain.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).select(
        "text_sha256", "pos", mark(F.col("chunk")).alias("h"), F.sha2("chunk", 256).alias("sha"))
    number = placed.join(table, ["h", "sha"]).groupBy("text_sha256").agg(
        F.array_sort(F.collect_set(F.struct("pos", "h2"))).alias("which"))
    return rows.join(number, "text_sha256", "left").select(
        "doc_id", "_row", "text_sha256",
        F.concat("recipe", F.coalesce(F.flatten(F.transform("which", lambda w: F.array(w["pos"].cast("long"), w["h2"]))),
                                      F.array().cast("array<long>"))).alias("recipe"))


def exact_dedup(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest doc_id of a group stays."""
    rows = recipes(docs, hash_bits)
    out = with_group_totals(rows, ["recipe"], "_row", keep_id=("max", "doc_id"), group_size=("count", "_row"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
