"""Licence notices by a positional rare-token index (DataFrame functions only).

The index holds, for each word of the licence templates that isn't a function word, its postings (template, position) in
the mandatory key phrases. A template is in question for a file that has all words of its key phrases. The file's licence
words are looked up from the highest IDF (over all documents of the table) down, until each template in question has had
two of its places looked up (or all, if it has one); a file with none in question looks up nothing. Each place of a word
looked up proposes an alignment for each of its postings (template, place minus position). The postings are intersected
by relative position: an alignment stays that two places propose (one, for templates with one), found by sorting.
An alignment holds if all key phrases of the template stand word for word at their places in it; as two places of those
phrases were looked up, no holding alignment is missed. The share of a holding alignment is that of the template's indexed words that
stand at their places.

Base phrases are counted at every place where their words stand consecutively; their labels always stay.

Edge cases: a null text is empty; an empty text has no words, no labels and score 0; a table without rows gives none.
Repeated rows are scanned each, as are rows without a ``doc_id``. Columns of the input beside ``doc_id`` and ``text``
are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, words of a notice, and the phrases of it that must stand in the file.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "licensed under the apache 2 0 license", ["apache 2 0 license"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license version", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "with or without modification are permitted"]),
    ("bsd", "released under the bsd license", ["the bsd license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "distribute this software for any purpose"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "released under the creative commons zero cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("gpl", "spdx license identifier gpl", ["spdx license identifier gpl"]),
    ("lgpl", "spdx license identifier lgpl", ["spdx license identifier lgpl"]),
    ("agpl", "spdx license identifier agpl", ["spdx license identifier agpl"]),
    ("bsd", "spdx license identifier bsd", ["spdx license identifier bsd"]),
    ("isc", "spdx license identifier isc", ["spdx license identifier isc"]),
    ("mpl-2", "spdx license identifier mpl 2 0", ["spdx license identifier mpl 2 0"]),
    ("cc-by-nc", "spdx license identifier cc by nc", ["spdx license identifier cc by nc"]),
    ("cc-by-sa", "spdx license identifier cc by sa", ["spdx license identifier cc by sa"]),
    ("cc-by", "spdx license identifier cc by 4 0", ["spdx license identifier cc by 4 0"]),
    ("cc0", "spdx license identifier cc0 1 0", ["spdx license identifier cc0 1 0"]),
    ("unlicense", "spdx license identifier unlicense", ["spdx license identifier unlicense"]),
]

#: Function words, which are not indexed.
FUNCTION_WORDS = set("a and any are by for free in into is met of or person provided that the this to use v with without zero 0 1 2 4".split())

#: More than any template is long, so that alignments before the file's first word are numbers, too.
SHIFT = 1000
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def postings() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(TEMPLATES):
        for i, w in enumerate(words.split()):
            if w not in FUNCTION_WORDS:
                out.setdefault(w, []).append((t, i))
    for phrase in BASE:
        for w in phrase.split():
            if w not in FUNCTION_WORDS:
                out.setdefault(w, [])
    return out


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), "")


def licence_words(words: Column, vocabulary: list[str]) -> Column:
    """The places of indexed words: array of (w, i), i from 0."""
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())


def stands(words: Column, start: Column, phrase: str) -> Column:
    own = phrase.split()
    at = F.slice(words, F.greatest(start + F.lit(1), F.lit(1)), F.lit(len(own)))
    return (start >= 0) & (at == F.array(*map(F.lit, own)))


def key_places(t: int) -> list[int]:
    """Where the key phrases of template ``t`` begin in its words."""
    _, text, keys = TEMPLATES[t]
    own = text.split()
    return [next(i for i in range(len(own)) if own[i:i + len(k)] == k) for k in map(str.split, keys)]


def key_postings() -> list[list[tuple[str, int]]]:
    """The indexed words of each template's key phrases with their positions in the template."""
    return [sorted({(w, lead + i) for lead, key in zip(key_places(t), keys) for i, w in enumerate(key.split()) if w not in FUNCTION_WORDS})
            for t, (_, _, keys) in enumerate(TEMPLATES)]


def scan(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, base`` (label, start), ``hits`` (label, start, share) and ``score``."""
    vocabulary = sorted(postings())
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # Document frequencies of the indexed words over all documents: as many rows as the index has words.
    counts = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.transform(
        licence_words(F.col("words"), vocabulary), lambda x: x["w"])))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}
    n = df.get("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    keys = key_postings()
    lone = [t for t, own in enumerate(keys) if len(own) == 1]

    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", licence_words(F.col("words"), vocabulary).alias("occ"))
    words = F.when(F.size("occ") > 0, F.col("words")).otherwise(F.array().cast("array<string>"))
    found = found.select("doc_id", "n_words", words.alias("words"), "occ")

    def places(phrase: str, label: str) -> Column:
        own_words = phrase.split()
        lead, first = min(((i, w) for i, w in enumerate(own_words) if w not in FUNCTION_WORDS), key=lambda x: (-idf[x[1]], x))
        own = F.filter("occ", lambda o: (o["w"] == first) & stands(F.col("words"), o["i"] - lead, phrase))
        return F.transform(own, lambda o: F.struct(F.lit(label).alias("label"), (o["i"] - lead).alias("start")))

    base = [places(phrase, label) for phrase, label in BASE.items()]
    have = F.array_distinct(F.transform("occ", lambda o: o["w"]))
    found = found.select("doc_id", "n_words", "words", "occ", F.concat(*base).alias("base"), have.alias("have"))
    # The rank down to which a template in question has the file's words looked up.
    asked = F.array(*(F.when(F.size(F.array_except(F.array(*map(F.lit, sorted({w for w, _ in own}))), F.col("have"))) == 0,
                             F.struct(F.lit(t).alias("t"), F.lit(sorted(rank[w] for w, _ in own)[:2][-1]).alias("down"))) for t, own in enumerate(keys)))
    none = F.array().cast("array<struct<t:int,down:int>>")
    found = found.withColumn("asked", F.when(F.size("have") > 0, F.filter(asked, lambda x: x.isNotNull())).otherwise(none))
    found = found.select("doc_id", "n_words", "words", "base", "occ", F.transform("asked", lambda x: x["t"]).alias("asked"), F.array_max(F.transform("asked", lambda x: x["down"])).alias("down"))
    by_word: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(keys):
        for w, at in own:
            by_word.setdefault(w, []).append((t, at))
    index = F.create_map(*(x for w in sorted(by_word) for x in (F.lit(w), F.struct(
        F.lit(rank[w]).alias("rank"), F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(p).alias("p")) for t, p in by_word[w])).alias("at")))))
    entries = F.transform("occ", lambda o: F.struct(o["i"].alias("i"), index[o["w"]].alias("e")))
    looked = F.filter(entries, lambda o: o["e"]["rank"] <= F.col("down"))
    # Alignments as numbers, template + (start + SHIFT) * number of templates, in order.
    numbers = F.flatten(F.transform(looked, lambda o: F.transform(
        F.filter(o["e"]["at"], lambda p: F.array_contains("asked", p["t"].cast("int"))), lambda p: (o["i"] - p["p"] + SHIFT) * len(TEMPLATES) + p["t"])))
    found = found.select("doc_id", "n_words", "words", "base", F.when(F.col("down").isNotNull(), F.array_sort(numbers)).otherwise(F.array().cast("array<bigint>")).alias("n"))
    again = lambda i, back: F.coalesce(F.get("n", i - back) == F.get("n", i), F.lit(False))
    enough = F.filter("n", lambda a, i: F.when((a % len(TEMPLATES)).isin(lone), ~again(i, 1)).otherwise(again(i, 1) & ~again(i, 2)))
    agreed = F.transform(enough, lambda a: F.struct((a % len(TEMPLATES)).cast("int").alias("t"), (F.floor(a / len(TEMPLATES)) - SHIFT).cast("int").alias("start")))
    found = found.select("doc_id", "n_words", "words", "base", agreed.alias("proposed"))

    def verified(a: Column) -> Column:
        out = F.lit(False)
        for t, (_, _, keys) in enumerate(TEMPLATES):
            holds = F.lit(True)
            for lead, key in zip(key_places(t), keys):
                holds = holds & stands(F.col("words"), a["start"] + lead, key)
            out = F.when(a["t"] == t, holds).otherwise(out)
        return out

    def share(a: Column) -> Column:
        out = F.lit(0.0)
        for t, (_, text, _) in enumerate(TEMPLATES):
            own = [(i, w) for i, w in enumerate(text.split()) if w not in FUNCTION_WORDS]
            there = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in own)), lambda x: F.get(F.col("words"), a["start"] + x["i"]) == x["w"])
            out = F.when(a["t"] == t, F.size(there) / F.lit(float(len(own)))).otherwise(out)
        return out

    labels = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    found = found.select("doc_id", "n_words", "words", "base", F.filter("proposed", verified).alias("aligned"))
    hits = F.transform("aligned", lambda a: F.struct(F.element_at(labels, a["t"] + 1).alias("label"), a["start"].alias("start"), share(a).alias("share")))
    found = found.select("doc_id", "n_words", "base", hits.alias("hits"))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))
    return found.withColumn("score", F.when(F.size("base") > 0, 1.0).when(F.size("hits") > 0, 0.5 + 0.5 * best).otherwise(0.0))


def digest(found: DataFrame) -> DataFrame:
    own = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"])))
    starts = F.transform("base", lambda h: h["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(own(F.col("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own(F.col("base")), own(F.col("hits")))), ",").alias("labels"), "score")
