"""The corpus queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, pii, ranked_search, sharding, spelling, toxicity
from .common import docs_of

#: The key of the query; a job passes its own secret.
PII_KEY = "example key of the query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = sharding.tree(40)
    return sharding.shard(docs_of(spark, sf_dir), now, sharding.grow(now, 40))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs_of(spark, sf_dir), PII_KEY).select("doc_id", "text", "n_pii", "kinds")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_of(spark, sf_dir))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document."""
    found = decontamination.scan(docs_of(spark, sf_dir).select("doc_id", "text"), docs_of(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(docs_of(spark, sf_dir)))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(docs_of(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs_of(spark, sf_dir), width=3, threshold=85)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = docs_of(spark, sf_dir), language_id.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, docs_of(spark, sf_dir, "labels"), ~held)
    return toxicity.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs_of(spark, sf_dir))


ORACLE_SQL["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = byte_bpe.tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = codec.encode(docs_of(spark, sf_dir).select("doc_id", "text"), packed=True).drop("text")
    return codec.decode(ids).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(docs_of(spark, sf_dir))


#: crc32 walks the UTF-8 bytes with a table made by its rule; near words meet in what one deletion leaves of them.
ORACLE_SQL["op12_spelling"] = """
WITH RECURSIVE bits(v, x, k) AS (SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
    UNION ALL SELECT v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
  tab AS (SELECT list(x ORDER BY v) AS t FROM bits WHERE k = 8),
  runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
  hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6),
  hashed AS (SELECT run, times, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS h FROM hexed, tab),
  spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
  w AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
  del AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
  pair AS (SELECT DISTINCT x.word, y.word AS other, y.n AS other_n FROM del x JOIN del y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT DISTINCT d.word, w.word, w.n FROM del d JOIN w ON d.rest = w.word UNION SELECT DISTINCT w.word, d.word, d.n FROM del d JOIN w ON d.rest = w.word),
  seen AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM pair GROUP BY 1),
  form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN seen USING (word)),
  way AS (SELECT word, word AS at FROM form UNION ALL SELECT way.word, form.form FROM way JOIN form ON form.word = way.at WHERE form.form IS NOT NULL),
  root AS (SELECT way.word, way.at AS root FROM way JOIN form ON form.word = way.at WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"), k=50)


ORACLE_SQL["op11_ranked_search"] = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  tok AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM low),
  size AS (SELECT count(*) AS n, sum(len(a))::BIGINT AS l FROM tok WHERE len(a) > 0),
  item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  post AS (SELECT r, doc_id, len, term, count(*) AS tf FROM (SELECT r, doc_id, len(a) AS len, unnest(a) AS term FROM tok) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, size GROUP BY term, n),
  part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len * n) // l)))) AS s FROM post JOIN w USING (term), size),
  score AS (SELECT item_id, r, doc_id, sum(s)::BIGINT AS score FROM item JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM score) WHERE rank <= 50
"""
