"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontam, lexical, licenses, packing, pii, quality, search, sharding, simhash, substrings, suffixes, toxicity, whitening
from tidegauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# terms by RE2; the same classes as on bytes, as all of them are ASCII
SQL["op5_search"] = rf"""
WITH word AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
size AS (
    SELECT d.doc_id, coalesce(w.n, 0) AS n
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM word GROUP BY ALL) w ON w.doc_id = d.doc_id
), corpus AS (SELECT count(*)::DOUBLE AS n, avg(n) AS mean FROM size),
scored AS (
    SELECT q.doc_id AS query_id, t.doc_id, round(sum(
        ln(1 + (corpus.n - df.df + 0.5) / (df.df + 0.5))
        * t.tf * {search.K1 + 1} / (t.tf + {search.K1} * ({1 - search.B} + {search.B} * size.n / corpus.mean))
    ), {search.DECIMALS}) AS score
    FROM tf q JOIN tf t ON t.term = q.term JOIN df ON df.term = q.term JOIN size ON size.doc_id = t.doc_id, corpus
    WHERE q.doc_id % 20 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {search.TOP}
"""

# the table is filled one claim at a time: claim k is made by shard k mod SHARDS
SQL["op8_sharding"] = f"""
WITH RECURSIVE claims(k, taken) AS (
    SELECT 0, list_transform(range({sharding.SLOTS}), lambda x: -1)
    UNION ALL
    SELECT k + 1, list_concat(list_concat(taken[1:slot], [(k % {sharding.SHARDS})]), taken[slot + 2:])
    FROM (
        SELECT k, taken, list_filter(
            list_transform(range({sharding.SLOTS}), lambda j: (
                (k % {sharding.SHARDS} + 1) * {sharding.OFFSET_FACTOR} % {sharding.SLOTS}
                + j * ((k % {sharding.SHARDS} + 1) * {sharding.SKIP_FACTOR} % ({sharding.SLOTS} - 1) + 1)
            ) % {sharding.SLOTS}), lambda s: taken[s + 1] = -1)[1] AS slot
        FROM claims WHERE k < {sharding.SLOTS}
    )
), filled AS (SELECT taken FROM claims WHERE k = {sharding.SLOTS}),
lookup AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(taken) AS shard FROM filled),
placed AS (
    SELECT doc_id, source, n_chars,
        (doc_id % {sharding.SLOTS * 1000} * {sharding.KEY_FACTOR} + (doc_id >> 16) % {sharding.SLOTS}) % {sharding.SLOTS} AS slot
    FROM documents
)
SELECT doc_id, source, n_chars, slot, shard::INTEGER AS shard FROM placed JOIN lookup USING (slot)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, asked)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# terms by RE2; HUGEINT, so that no product overflows
SQL["op13_lexical"] = rf"""
WITH low AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), asked AS (
    SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark
), word AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term FROM low
), want AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term FROM asked
), tf AS (SELECT doc_id, term, count(*)::HUGEINT AS tf FROM word GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::HUGEINT AS n FROM tf GROUP BY ALL),
corpus AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM size),
weight AS (
    SELECT term, floor({lexical.W_SCALE} * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w
    FROM tf, corpus GROUP BY term, docs
), scored AS (
    SELECT item_id, doc_id, sum(w * (
        ({lexical.TF_SCALE} * tf) // (1000 * tf + 8 * ({100 - lexical.B} + ({lexical.B} * n * docs) // terms))
    ))::BIGINT AS score
    FROM want JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), corpus GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}
"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
