"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.llm import additive_ann, bpe, byte_cnn, line_dedup, nnpu, packing, quality_rules, simhash, suffix_dedup, token_rollup
from gaugeframe.llm._shared import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(table(spark, sf_dir, "embeddings"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_additive_ann": op3_additive_ann,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_nnpu": op9_nnpu,
    "op10_token_rollup": op10_token_rollup,
}
#: Tokens, fingerprints and XXH64 chunks, models and suffix arrays have no SQL form; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": """
        WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
        ln AS (SELECT doc_id, host, lower(regexp_replace(trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \\t\\x0B\\f\\r]+', ' ', 'g')) AS l,
                      len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, host, unnest(ls) AS l FROM w)),
        hd AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
        fq AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT doc_id) AS n FROM ln GROUP BY host, l) JOIN hd USING (host) WHERE n > 20 AND n > docs * 0.001),
        lost AS (SELECT doc_id, count(*) AS k, sum(n) AS n FROM ln JOIN fq USING (host, l) GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
                     coalesce(lost.k, 0) AS n_frequent_lines, CAST(len(ws) - coalesce(lost.n, 0) AS BIGINT) AS n_kept_words
              FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept FROM m
    """,
}
