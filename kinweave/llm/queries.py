"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, languages, licenses, mixing, pii, quality, simhash, substrings, token_counts, toxicity
from .common import crc_mod, table

#: Vocabulary file for op2; a parameter, never copied here.
TOKENIZER_FILE = os.environ.get("KINWEAVE_TOKENIZER", "byte_bpe_50k.json")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.fit_sample(docs)
    found = languages.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block", "place")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_extraction": op1_pii_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_source_mixing": op7_source_mixing,
    "op8_license_scans": op8_license_scans,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": substrings.SQL,
    "op8_license_scans": licenses.SQL,
    "op7_source_mixing": mixing.SQL,
    "op9_benchmark_decontamination": contamination.SQL,
}


# --- parts of operators that SQL can state though it can't state the whole: the base spans of op1, the counts of op10 ---


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii_extraction(spark, sf_dir).drop("spans")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).drop("kept", "distance", "cut")


PARTS = {"pii_base_spans": pii_base_spans, "quality_counts": quality_counts}

_FOUND = """SELECT r, '{kind}' AS kind, {at} AS ord, m[i] AS v, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT r, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{rx}') AS m, regexp_split_to_array(t, '{rx}') AS b FROM d))"""
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS_SQL = {
    "pii_base_spans": "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_FOUND.format(kind=k, at=i, rx=rx) for i, (k, rx) in enumerate(_PLAIN.items()))
    + """), g AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM f),
h AS (SELECT * FROM g WHERE CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(ltrim(x, '0'), 3) AS INT) <= 255))
  WHEN 'card' THEN length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(n), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE (2 * CAST(c AS INT)) // 10 + (2 * CAST(c AS INT)) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(n) BETWEEN 9 AND 15 ELSE true END),
s AS (SELECT r, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(v) AS BIGINT), ',' ORDER BY ord, start) AS line FROM h GROUP BY r)
SELECT doc_id, coalesce(e, 0)::BIGINT AS n_email, coalesce(i, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(p, 0)::BIGINT AS n_phone, sha256(coalesce(line, '')) AS base_sha256 FROM d LEFT JOIN s USING (r)""",
    "quality_counts": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM often) GROUP BY r),
c AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
FROM c LEFT JOIN rep USING (r)""",
}
