"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm import decontaminate, exact_dedup, language_id, mixing, personal_data, simhash, token_counts, token_files, toxicity, warc
from lakeward.llm.common import held, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = held(F.col("doc_id"), 3, 1)
    scored = toxicity.score(docs.withColumn("held_out", out), toxicity.fit(docs, labels, ~out))
    return scored.select("doc.doc_id", "doc.held_out", "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, runs = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(runs, folder).drop("payload")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held(F.col("doc_id"), 4, 2)
    dictionaries = language_id.fit(docs, ~out)
    found = language_id.identify(docs.select("doc_id", "text", out.alias("held_out")), dictionaries)
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "rejected")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a review whose edits are drawn from its doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.review_edits().alias("edits"))
    return token_counts.edit_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_language_id, op4_simhash, op5_decontamination, op6_exact_dedup, op7_token_output, op8_token_counts, op9_mixing, op10_personal_data)}


ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to FROM q""",
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        v AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS phrase FROM i WHERE len(w) > 0),
        l AS (SELECT DISTINCT n FROM v),
        g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS phrase FROM d, l WHERE len(w) >= n),
        m AS (SELECT g.doc_id, g.s, g.n, v.item_id FROM g JOIN v USING (n, phrase)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_mixing": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, ''))) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        s1 AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s0),
        s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS need FROM s1),
        s3 AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(cap) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, CAST(sum(source_size) OVER () AS BIGINT) AS total
            FROM s2 WINDOW w AS (ORDER BY need, source NULLS LAST)),
        s4 AS (SELECT *, (total * 1.5::DOUBLE - capped) / open AS level FROM s3),
        s5 AS (SELECT *, (SELECT arg_min(level, nth) FROM s4 WHERE level <= need) AS fixed FROM s4),
        s6 AS (SELECT source, source_size, CASE WHEN fixed IS NULL THEN cap ELSE least(cap, fixed * weight) END AS target FROM s5),
        s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE) ELSE 0 END AS whole FROM s6),
        p AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest, CASE WHEN source_size > 0 THEN least(greatest(0.0::DOUBLE, target - whole * source_size) / source_size, 1.0::DOUBLE - 1e-9::DOUBLE) ELSE 0 END AS f FROM s7),
        r0 AS (SELECT d.*, p.* EXCLUDE (source), (CAST('0x' || substr(md5('7:' || coalesce(key, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        r1 AS (SELECT *, CASE WHEN f > 0 THEN u * (1.0::DOUBLE - f) / (u * (1.0::DOUBLE - f) + (1.0::DOUBLE - u) * f) ELSE 1 END AS v FROM r0),
        r2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, key, size ROWS UNBOUNDED PRECEDING) AS through FROM r1),
        r3 AS (SELECT *, through <= rest AND rest > 0 AS inside, sum(CASE WHEN through <= rest THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY v, key, size ROWS UNBOUNDED PRECEDING) AS after FROM r2),
        g AS (SELECT source, CAST(0 AS HUGEINT) AS k, any_value(rest) - coalesce(max(through) FILTER (inside), 0) AS gap, CAST(NULL AS BIGINT) AS doc_id, false AS one FROM r3 WHERE rest > 0 GROUP BY source
            UNION ALL SELECT n.source, n.after, CASE WHEN n.size <= g.gap THEN g.gap - n.size ELSE g.gap END, n.doc_id, n.size <= g.gap FROM g JOIN r3 n ON n.source IS NOT DISTINCT FROM g.source AND n.after = g.k + 1 AND NOT n.inside)
        SELECT r3.doc_id, size, source_size, target, CAST((whole + CASE WHEN inside OR coalesce(one, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r3 LEFT JOIN (SELECT doc_id, one FROM g WHERE one) x ON x.doc_id = r3.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
