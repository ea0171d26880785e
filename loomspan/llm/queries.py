"""Queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from .encode import encode_corpus
from .languages import document_languages, label_defects, language_segments
from .leakage import leaked_items
from .markup import cleaned, found, texts_of
from .near_duplicates import groups, memberships, similar_classes, similar_pairs
from .pairs import all_pairs, pair_defects
from .split import split_pieces


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects(all_pairs(read_table(spark, folder, "golden_set"), read_table(spark, folder, "eval_result"))).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_defects(spark, folder).where("defect IS NOT NULL").select("origin", "pair_id", "defect").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(*similar_classes(read_table(spark, folder, "knowledge_chunk"))).select("chunk_a", "chunk_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups(*similar_classes(read_table(spark, folder, "knowledge_chunk")))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return memberships(*similar_classes(read_table(spark, folder, "knowledge_chunk")))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_pieces(read_table(spark, folder, "knowledge_chunk"), read_table(spark, folder, "split_limit")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_pieces(read_table(spark, folder, "knowledge_chunk"), read_table(spark, folder, "split_limit"))
    return pieces.where("piece_no = 0").select("chunk_id").distinct()


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return texts_of(read_table(spark, folder, "knowledge_chunk"), read_table(spark, folder, "golden_set"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return found(_marked(spark, folder))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(_marked(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "heldout_item"))


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    return document_languages(read_table(spark, folder, "documents"))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language_segments(read_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return label_defects(p9_languages(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_defects": p3_defects, "p4_found": p4_found, "p4_groups": p4_groups, "p4_classes": p4_classes, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_clean": p6_clean, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found, "p9_languages": p9_languages, "p9_segments": p9_segments}
_P8 = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\pL\\p{Nd}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(text), '[^\\pL\\p{Nd}]', '', 'g') AS t FROM heldout_item),
w AS (SELECT DISTINCT item_id, substr(t, k::BIGINT, 50) AS g FROM (SELECT item_id, t, unnest(generate_series(1, length(t) - 49)) AS k FROM i WHERE length(t) >= 50)),
g AS (SELECT doc_id, substr(t, k::BIGINT, 50) AS g FROM (SELECT doc_id, t, unnest(generate_series(1, length(t) - 49)) AS k FROM d WHERE length(t) >= 50))
SELECT DISTINCT doc_id, item_id FROM g JOIN w USING (g)"""

_P5 = """
SELECT DISTINCT c.id AS chunk_id FROM (SELECT *, CASE WHEN json_valid(meta) THEN meta->>'method' END AS m FROM knowledge_chunk) c
LEFT JOIN split_limit l ON l.method = c.m
WHERE length(c.content) // 4 > coalesce(l.max_tokens, (SELECT max_tokens FROM split_limit WHERE method = 'general'))"""

SQL: dict[str, str] = {"p5_found": _P5, "p8_found": _P8}
