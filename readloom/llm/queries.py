"""The queries of the corpus operators, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, hmm, mixing, near, pii, quality, repeats, toxicity, warc
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id bigint, messages array<struct<role string, content string>>")
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(extra))
    return chat.digest(chat.formatted(turns))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(spark, table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.joined(spark, table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(spark, table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(spark, table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_repeats, op3_jaccard, op4_surrogates, op5_mixing, op6_quality, op7_warc, op8_decontaminate, op9_hmm, op10_toxicity)
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        p AS (
            SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
                           ELSE 5 + length(replace({_ESCAPED.format("role")}, ':', '\:')) END
                      + length({_ESCAPED.format("text")}) + 4 + 2 + 8 AS chars,
                   CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op8_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        n AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n WHERE len(w) >= k)),
        m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
