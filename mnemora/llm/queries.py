"""Registered queries over the operators, and the SQL counterparts that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import (
    best_fit,
    byte_bpe,
    chat,
    cutting_stock,
    hard_negatives,
    identifiers,
    licenses,
    line_dedup,
    near_duplicates,
    permutation_index,
    prefix_trie,
    quality,
    url_rules,
)
from mnemora.llm.common import table


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op2_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return identifiers.identifier_report(table(spark, folder, "documents"))


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts spell control strings."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    return chat.chat_report(rows.unionByName(planted))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op5_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    return cutting_stock.pack_documents(table(spark, folder, "documents"))


def op6_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.packed_matrices(table(spark, folder, "documents"))


def op7_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.nearest(table(spark, folder, "embeddings"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.linked_classes(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.bpe_report(table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined_negatives(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


Q = {
    f.__name__: f
    for f in (
        op1_url_rules,
        op2_identifiers,
        op3_chat,
        op4_licenses,
        op5_cutting_stock,
        op6_best_fit,
        op7_permutation_index,
        op8_near_duplicates,
        op9_quality,
        op10_byte_bpe,
        op11_hard_negatives,
        op12_prefix_trie,
        op13_line_dedup,
    )
}

S = {
    "op3_chat": chat.chat_sql(),
    "op11_hard_negatives": hard_negatives.MINING_SQL,
    "op12_prefix_trie": prefix_trie.TRIE_SQL,
    "op13_line_dedup": line_dedup.LINE_SQL,
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda w: w <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT u, v FROM pairs JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id
            WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
}
