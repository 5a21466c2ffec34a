"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, ctw, decontam, langid, licenses, packing, quality, sharding, simhash, topk, toxicity, warc
from ._common import remainder, shared_folder, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.train(documents))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out(folds: int, held: int) -> Column:
    """Whether a document is in the held-out fold; false for a null id."""
    return F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), "quality", folds=4, held=2)
    return quality.score(documents, model).select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary, end_id=2, capacity=4096, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", held_out(10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), "toxic", folds=3, held=1)
    return toxicity.score(documents, model).select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(rows, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents, remainder(F.col("doc_id"), 4) != 2)
    return langid.predict(documents, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_ctw": op6_ctw,
    "op7_decontam": op7_decontam,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_langid": op10_langid,
    "op11_warc": op11_warc,
    "op12_conversations": op12_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (
            SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, sha256(payload) AS whole FROM p),
        r AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, whole) AS largest FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
        FROM r""",
    # The cheapest repair from each state, built from the last turn forwards as (cost, audit, repaired text); crc32 by its table.
    "op12_conversations": """
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
                FROM range(256) r(i))),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations),
        kinds AS (
            SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                        lambda v, b: xor(v >> 8, t[1 + (xor(v, b) & 255)])), 4294967295) % 20 AS kind
            FROM keyed k, crc),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                   right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
            FROM damaged),
        turns AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                   left(role, 1) AS initial, last = '' AS blank, last <> '' AND seen AS duplicate, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS truncated,
                   left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
            FROM numbered),
        counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM turns GROUP BY conv_id),
        best AS (
            SELECT conv_id, n AS i, {'c': 0, 'a': '', 't': ''} AS p, {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s,
                   {'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'} AS u, {'c': 0, 'a': '', 't': ''} AS a
            FROM counted
            UNION ALL
            SELECT conv_id, i,
                   least(p, {'c': u.c + 2, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}) AS p,
                   least(s, {'c': u.c + 2, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}, {'c': a.c + 4, 'a': 'II' || a.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || a.t}) AS s,
                   least(u, {'c': a.c + 2, 'a': 'I' || a.a, 't': chr(10) || 'assistant:' || a.t}) AS u,
                   least(a, {'c': u.c + 2, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}) AS a
            FROM (
                SELECT b.conv_id, b.i - 1 AS i,
                       least({'c': b.p.c + 3, 'a': 'D' || b.p.a, 't': b.p.t}, own_u,
                             CASE WHEN NOT must AND x.initial = 's' THEN {'c': b.s.c + cut, 'a': 'K' || b.s.a, 't': said || b.s.t} END) AS p,
                       least({'c': b.s.c + 3, 'a': 'D' || b.s.a, 't': b.s.t}, own_u) AS s,
                       least({'c': b.u.c + 3, 'a': 'D' || b.u.a, 't': b.u.t}, own_a) AS u,
                       least({'c': b.a.c + 3, 'a': 'D' || b.a.a, 't': b.a.t}, own_u) AS a
                FROM best b JOIN (
                    SELECT *, blank OR duplicate AS must, CAST(truncated AS INTEGER) AS cut, chr(10) || role || ':' || text AS said FROM turns) x
                  ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i,
                LATERAL (SELECT
                    CASE WHEN NOT must THEN CASE WHEN x.initial = 'u' THEN {'c': b.u.c + cut, 'a': 'K' || b.u.a, 't': said || b.u.t}
                         ELSE {'c': b.u.c + cut + 2, 'a': 'R' || b.u.a, 't': chr(10) || 'user:' || x.text || b.u.t} END END AS own_u,
                    CASE WHEN NOT must THEN CASE WHEN x.initial = 'a' THEN {'c': b.a.c + cut, 'a': 'K' || b.a.a, 't': said || b.a.t}
                         ELSE {'c': b.a.c + cut + 2, 'a': 'R' || b.a.a, 't': chr(10) || 'assistant:' || x.text || b.a.t} END END AS own_a)))
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(b.p.c, 0) AS BIGINT) AS cost, coalesce(b.p.a, '') AS audit,
               sha256(coalesce(substr(b.p.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0""",
}
