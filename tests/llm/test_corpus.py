"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns, and none."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm.common import cut
from logloom.llm import decontamination, exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, pii, sharding, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, slot string, keep_id string, score string, rank int"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))


def docs_with_copies():
    base = [words(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        w = t.split()
        w[30] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, t), (300 + i, t.upper())]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "two words"), (404, "two  WORDS"), (405, "é 日本 x"), (406, words(5000)), (0, base[0])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", "c", None][i % 4], "en", "s", "k", "z", 1) for i, t in docs_with_copies()]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact(docs, none, bits):
    by = defaultdict(list)
    for r in docs.collect():
        by[r.text or ""].append(r.doc_id)
    want = Counter((i, max(v), len(v)) for v in by.values() for i in v)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, bits).collect()) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_are_lossless(docs):
    assert docs.filter(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_sharding(docs, none):
    topology = sharding.tree(40)
    rows = sharding.shard(docs, topology, sharding.grow(topology, 40)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(none, topology).count() == 0


def test_weights_move_rows_only_below_them(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = sharding.tree(8), sharding.tree(8, weights={0: 3.0})
    moved = ids.select(sharding.shard_of(F.col("doc_id"), a).alias("a"), sharding.shard_of(F.col("doc_id"), b).alias("b")).filter("a <> b").collect()
    assert moved and all(r.b in (0, 1) for r in moved)  # region r0 has shards 0 and 1


def test_pii(spark, none):
    text = "bob@x.org 4111 1111 1111 1111 2024-02-29 30.02.2024 078-05-1120 10.0.0.1 300.1.1.1 GB82WEST12345698765432"
    rows = spark.createDataFrame([(1, text), (2, "4111111111111111 " + text), (3, None), (4, ""), (5, "no values")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, "k").collect()}
    new = got[1].text
    assert "30.02.2024" in new and "300.1.1.1" in new and not any(v in new for v in ("bob@", "4111", "2024-02-29", "078-05-1120", "10.0.0.1", "GB82"))
    assert [len(a) == len(b) for a, b in zip(text.split()[1:5], new.split()[1:5])] == [True] * 4
    card = "".join(new.split()[1:5])
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card)))
    assert total % 10 == 0 and got[2].text == card + " " + new
    iban = new.split()[-1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "no values") and got[1].kinds == "card,date,email,iban,ip,ssn"
    assert pii.pseudonymise(none, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    key = pii.Key(*map(F.lit, pii.Key.row("k")))
    n = spark.range(319 * 229).select("id", pii.feistel_number(F.col("id"), 319, 229, key, "t").alias("x"))
    assert n.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (319 * 229, 0, 319 * 229 - 1)
    assert n.filter(pii.feistel_number(F.col("x"), 319, 229, key, "t", True) != F.col("id")).count() == 0
    for width in (1, 2, 3):
        t = spark.range(10 ** width).select(F.lpad(F.col("id").cast("string"), width, "0").alias("v")).select("v", pii.feistel_text(F.col("v"), pii.DIGITS, key, "t").alias("x"))
        assert t.agg(F.countDistinct("x")).first()[0] == 10 ** width and t.filter("x <> v").count() > 0
        assert t.filter(pii.feistel_text(F.col("x"), pii.DIGITS, key, "t", True) != F.col("v")).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs, block=8).collect()
    size = Counter()
    source = defaultdict(int)
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size[(r.doc_id, n)] += 1
        source[r.source] += n
    assert Counter((r.doc_id, r["size"]) for r in rows) == size and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    weight = dict(zip(sorted(source, key=lambda s: (s is None, s)), (5, 2, 1, 5)))
    left, want, open_ = 1.5 * sum(source.values()), {}, set(source)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * source[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * source[s]
            left -= want[s]
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    assert {round(r.target, 4) for r in rows} == {round(x, 4) for x in want.values()}
    again = mixing.mix(docs.repartition(7), block=8).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again)
    assert mixing.mix(none).count() == 0


def test_language(spark, none):
    alphabets = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(4)) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train, ~language_id.held_out(F.col("doc_id")))
    got = language_id.predict(train, model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 and not r.rejected for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !", "x"), (4, "abcd " * 20000, "x")], "doc_id long, text string, score string")
    assert [r.lang_pred for r in language_id.predict(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "aa"]
    assert language_id.predict(none, language_id.fit(none)).count() == 0


def test_unknown_languages_are_rejected_and_clean_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs, ~held)
    clean = docs.filter(held & F.col("text").rlike(r"\p{L}"))
    got = language_id.predict(clean.withColumn("first", F.lit(0)).unionByName(clean.select("doc_id", "lang", F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"), F.lit(1).alias("first"))), model).collect()
    assert sum(r.rejected for r in got) <= 0.02 * len(got) and len(got) > 300
    letters = random.Random(5)
    unknown = ["Быстрая коричневая лиса перепрыгивает через ленивую собаку и бежит в тёмный лес", "Zażółć gęślą jaźń, a potem szybko pobiegł do lasu i nie wrócił już nigdy do domu",
               "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar",
               " ".join("".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(unknown + [" ".join([t] * 20) for t in unknown])], "doc_id long, text string")
    assert all(r.rejected for r in language_id.predict(odd, model).collect())


def test_decontamination(spark, none):
    items = [(1, words(30)), (2, "short"), (3, None), (4, words(25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1]
    edited = w[:40] + "#" + w[41:80] + w[82:]
    rows = [(1, words(50) + " " + w.upper() + "  " + words(50)), (2, words(40) + " " + edited + " " + words(9)), (3, words(200)), (4, None), (5, ""), (6, w[: len(w) // 2]), (7, "a short one")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4_000_000, 50):
        got = {r.doc_id: sorted((h.item_id, h.edits) for h in r.hits) for r in decontamination.scan(table, bench, slice_bytes=size).collect()}
        assert got == {1: [(1, 0)], 2: [(1, 3)], 3: [], 4: [], 5: [], 6: [], 7: [(2, 0)]}
    assert decontamination.scan(none, bench).count() == 0 and decontamination.scan(table, bench.limit(0)).filter("size(hits) > 0").count() == 0


def test_licenses(spark, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "Released under the MIT License. x under the mit-license"), (2, "Licensed under the Apache License, Version 2.0"), (3, "GNU General Public License, version 3"), (4, mit), (5, None), (6, ""),
            (7, "mit der license under"), (8, "éCC BY-NC cc by nc " + "x " * 30000)]
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "mit")
    assert [got[i].labels for i in range(1, 8)] == ["mit", "apache-2", "gpl", "mit", "", "", ""] and got[3].base_labels == "" and got[3].first_word is None
    assert (got[8].n_base, got[8].first_word, got[8].n_words) == (1, 3, 30006) and all(0 <= r.score <= 1 for r in got.values())
    assert license_scan.digest(license_scan.scan(none)).count() == 0


def test_every_notice_of_a_file_is_found(spark):
    """One file with the notices of all templates, apart and in long ordinary text, against a search word by word."""
    notices = [text for _, text, _ in license_scan.TEMPLATES]
    four = [next(t for label, t, _ in license_scan.TEMPLATES if label == name) for name in ("mit", "bsd", "isc", "gpl")]
    filler = " the subject files charge conditions to copy and modify public binary source license version " * 400
    texts = [" . ".join(four) + " 3", " x ".join(notices), filler + four[3] + filler + four[2], filler, "gnu gnu general public license", "version"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own, want = re.findall("[a-z0-9]+", text), set()
        for t, (label, _, keys) in enumerate(license_scan.TEMPLATES):
            places = list(zip(license_scan.key_places(t), map(str.split, keys)))
            want |= {(label, s) for s in range(-30, len(own)) if all(s + at >= 0 and own[s + at:s + at + len(k)] == k for at, k in places)}
        assert {(h.label, h.start) for h in got[i].hits} == want
    assert {h.label for h in got[0].hits} == {"mit", "bsd", "isc", "gpl"} and {h.label for h in got[1].hits} == {label for label, _, _ in license_scan.TEMPLATES}
    assert got[0].score == 1.0 and got[3].hits == [] and [h.start for h in got[4].hits] == [-5]


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><div class=cookie-banner><p>We use cookies</p></div><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <article><h1>A &amp; B</h1><p>First   paragraph with <b>bold<br>words, long enough.<p>Second one &eacute;, also with words.</article><div class="comments"><p>Nice post</p></div><footer>&copy; 2020</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got == {1: "A & B\nFirst paragraph with bold words, long enough.\nSecond one é, also with words.", 2: "", 3: ""}
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("attribute, hidden", [
    ('title="The hidden valley"', False), ('data-hidden="false"', False), ('onclick="toggleHidden()"', False), ('data-title="Unhidden"', False), ("alt='x hidden y'", False),
    ("title=hidden", False), ('aria-hidden="true"', False), ('class="hidden"', False), ('data-style="display:none"', False), ('style="--display:none"', False), ('title = "a" hidden', True),
    ("hidden", True), ('HIDDEN=""', True), ("class=a hidden/", True), ('title="it\'s" hidden=hidden', True), ('style="color:red; display : none"', True), ("style=display:none", True)])
def test_only_hidden_blocks_are_hidden(attribute, hidden):
    page = html_text.Page(f"<body><article {attribute}><p>Text of the page.</p></article></body>")
    assert page.hidden == [False, hidden, False]
    assert page.text(html_text.np.array([5.0, 5.0, 5.0])) == ("" if hidden else "Text of the page.")


def test_near(docs, none):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = near_dedup.near_dedup(docs, 3, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), root[i]) for i, s in sets.items()} and len(got) == docs.count()
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_in_many_blocks(spark, monkeypatch):
    """Groups far larger than a block, some of several components, against brute force."""
    for name, size in (("BLOCK", 4), ("FIRST", 5), ("STAR", 6)):
        monkeypatch.setattr(near_dedup, name, size)
    rounds, plain = [], near_dedup.second_round
    monkeypatch.setattr(near_dedup, "second_round", lambda *a: rounds.append(cut(plain(*a))) or rounds[-1])
    texts, draw = [], random.Random(11)
    for _ in range(3):
        base = words(60).split()
        for _ in range(45):
            w = list(base)
            for i in draw.sample(range(2, 58), draw.choice([0, 1, 1, 2, 2, 3])):
                w[i] = "new%d" % draw.randrange(10**6)
            texts.append(" ".join(w))
    own = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(rows, 3, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 5
    assert rounds and rounds[0].count() > 0



def test_blocks_find_the_same_links():
    import numpy as np
    own = [near_dedup.shingle_set((" ".join(["x%d" % (i // 4)] * 1 + ["w%d" % k for k in range(40)] + ["y%d" % (i % 7)])).encode(), 3) for i in range(30)]
    both = near_dedup.shared_counts(own, own)
    assert all(both[i, j] == len(np.intersect1d(own[i], own[j])) for i in range(30) for j in range(30))


def test_segments_are_those_of_brute_force():
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(12)]

        def best(a, b):
            spans = [(sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max(spans, default=(0,))
            return [] if top[0] <= 0 else best(a, top[2]) + [round(top[0], 6)] + best(top[3], b)
        assert sorted(round(s, 6) for s, _, _ in toxicity.segments(list(enumerate(scores)), 0.0)) == sorted(best(0, 12))


def test_toxicity(spark, none):
    rows = [(i, words(60) + (" awful nasty awful" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~language_id.held_out(F.col("doc_id")))
    got = toxicity.predict(docs, model).collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) >= 295
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "awful " * 20000)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.predict(odd, model).orderBy("doc_id").collect()] == [0, 0, 1]
    assert toxicity.predict(none, toxicity.fit(none, labels.limit(0), F.lit(True))).count() == 0


def test_pipeline_takes_effect(spark):
    import corpus_pipeline
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == names
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(b in " ".join(r.text.lower().split()) for r in docs.collect() for b in bench)
    assert docs.count() > 100 and docs.select("doc_id").distinct().count() == docs.count()
