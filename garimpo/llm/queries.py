"""Queries of this package, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from garimpo.llm import languages, leakage, mixing, near_duplicates, personal_data, structure, token_budget

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return structure.not_prose(_t(spark, folder, "raw_docs"))


def p1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return structure.quality(_t(spark, folder, "raw_docs"))


def p1_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return structure.quality_by_source(_t(spark, folder, "raw_docs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(_t(spark, folder, "raw_docs"))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.record_languages(_t(spark, folder, "raw_docs"))


def p3_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget.token_totals(_t(spark, folder, "raw_docs"), _t(spark, folder, "merges"), _t(spark, folder, "mix_targets"))


def p3_record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget.record_tokens(_t(spark, folder, "raw_docs"), _t(spark, folder, "merges"))


def p3_slices(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget.token_slices(_t(spark, folder, "raw_docs"), _t(spark, folder, "merges"), _t(spark, folder, "mix_targets"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_t(spark, folder, "raw_docs"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_t(spark, folder, "raw_docs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_t(spark, folder, "documents"), _t(spark, folder, "benchmark"))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, folder, "documents"), _t(spark, folder, "benchmark"))



def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets"))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.found(_t(spark, folder, "documents"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.redacted(_t(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_quality, p1_by_source, p2_found, p2_languages, p3_token_totals, p3_record_tokens, p3_slices, p4_found, p4_groups, p5_found, p5_items, p6_mix, p6_shares, p7_found, p7_redacted)}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"
_RUNS = "list_distinct(list_transform(generate_series(1, len(w) - {0} + 1), lambda i: array_to_string(w[i:i + {0} - 1], ' ')))"
_LEAKS = (
    f"WITH d AS (SELECT doc_id, {_WORDS.format('strip_accents(coalesce(text, chr(32)))')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('strip_accents(coalesce(text, chr(32)))')} AS w FROM benchmark), "
    f"a AS (SELECT doc_id, unnest({_RUNS.format(12)}) AS r FROM d WHERE len(w) >= 12), b AS (SELECT item_id, unnest({_RUNS.format(12)}) AS r FROM i WHERE len(w) >= 12), l AS (SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (r)) "
)
_SIMILAR = (
    f"t AS (SELECT seq, {_WORDS.format("coalesce(nullif(text, ''), nullif(content, ''), nullif(raw_content, ''), '')")} AS w FROM raw_docs), s AS (SELECT seq, {_RUNS.format(5)} AS g FROM t WHERE len(w) >= 30), "
    "e AS (SELECT seq, len(g) AS n, hash(unnest(g)) AS r FROM s), c AS (SELECT a.seq AS seq_a, b.seq AS seq_b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.r = b.r AND a.seq < b.seq GROUP BY ALL), "
    "f AS (SELECT seq_a, seq_b FROM c WHERE k >= 0.8 * (na + nb - k) - 1e-9)"
)
ORACLE_SQL: dict[str, str] = {
    "p4_found": f"WITH {_SIMILAR} SELECT seq_a, seq_b FROM f",
    "p4_groups": f"WITH RECURSIVE {_SIMILAR}, m AS (SELECT seq, min(seq) OVER (PARTITION BY list_sort(g)) AS class_id FROM s), "
    "l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM f JOIN m x ON x.seq = seq_a JOIN m y ON y.seq = seq_b WHERE x.class_id <> y.class_id), "
    "b AS (SELECT a, b FROM l UNION SELECT b, a FROM l), h(id, node) AS (SELECT DISTINCT class_id, class_id FROM m UNION SELECT h.id, b.b FROM h JOIN b ON b.a = h.node) "
    "SELECT seq, class_id, (SELECT min(node) FROM h WHERE h.id = class_id) AS group_id, (SELECT count(*) FROM b WHERE b.a = class_id)::BIGINT AS links FROM m",
    "p5_found": _LEAKS + "SELECT doc_id, item_id FROM l",
    "p5_items": _LEAKS + "SELECT item_id, (SELECT count(*) FROM l WHERE l.item_id = benchmark.item_id)::BIGINT AS n_documents FROM benchmark",
}
