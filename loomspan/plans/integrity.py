"""Queries for orphan references and for changes between snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import Child, Parent, orphan_references, orphan_report
from ..operators.snapshots_diff import change_counts, snapshot_changes
from ..sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "knowledge_chunk")
    tasks = read_table(spark, folder, "knowledge_processing_task")
    judged = read_table(spark, folder, "knowledge_relevance_judgment")
    children = [
        Child("knowledge_chunk", chunks, "id", "file_id", "created_at", "file"),
        Child("knowledge_processing_task", tasks, "id", "file_id", "created_at", "file"),
        Child("knowledge_relevance_judgment", judged, "id", "chunk_id", "created_at", "chunk"),
    ]
    parents = [Parent("file", read_table(spark, folder, "file_record"), "id", "created_at"), Parent("chunk", chunks, "id", "created_at")]
    return orphan_references(children, parents, read_table(spark, folder, "deletion_log"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p1_found(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(read_table(spark, folder, "knowledge_snapshot"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return change_counts(p2_found(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_counts": p2_counts}

_REF = r"nullif(regexp_replace(lower({}), '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '')"
_P1 = f"""
WITH refs AS (
  SELECT 'knowledge_chunk' AS child_table, id AS record_id, 'file' AS entity, {_REF.format('file_id')} AS ref, created_at FROM knowledge_chunk
  UNION ALL SELECT 'knowledge_processing_task', id, 'file', {_REF.format('file_id')}, created_at FROM knowledge_processing_task
  UNION ALL SELECT 'knowledge_relevance_judgment', id, 'chunk', {_REF.format('chunk_id')}, created_at FROM knowledge_relevance_judgment),
parents AS (
  SELECT entity, ref, min(created_at) AS born FROM (
    SELECT 'file' AS entity, {_REF.format('id')} AS ref, created_at FROM file_record
    UNION ALL SELECT 'chunk', {_REF.format('id')}, created_at FROM knowledge_chunk) GROUP BY entity, ref),
gone AS (SELECT DISTINCT lower(entity) AS entity, {_REF.format('entity_id')} AS ref FROM deletion_log)
SELECT DISTINCT child_table, record_id,
  CASE WHEN p.ref IS NOT NULL THEN 'late' WHEN g.ref IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
  strftime(make_timestamp(r.created_at * 1000000), '%Y-%m') AS period
FROM refs r LEFT JOIN parents p ON p.entity = r.entity AND p.ref = r.ref LEFT JOIN gone g ON g.entity = r.entity AND g.ref = r.ref
WHERE r.ref IS NOT NULL AND (p.ref IS NULL OR p.born > r.created_at)"""

_CANON = "CASE WHEN regexp_full_match({0}, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') AND contains({0}, '.') THEN rtrim(rtrim({0}, '0'), '.') ELSE {0} END"


def _fields(*names: str) -> str:
    return "[" + ", ".join(_CANON.format(f"(e->>'{n}')") for n in names) + "]"


_P2 = f"""
WITH numbered AS (
  SELECT id, knowledge_id, TRY_CAST(nullif(regexp_extract(translate(label, '０１２３４５６７８９', '0123456789'), '([0-9]+)', 1), '') AS BIGINT) AS n, created_at, snapshot_data AS d
  FROM knowledge_snapshot WHERE json_valid(snapshot_data)),
latest AS (SELECT DISTINCT * FROM numbered WHERE n IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY knowledge_id, n ORDER BY created_at DESC, id DESC) = 1),
linked AS (SELECT *, lag(id) OVER w AS old_id, lead(id) OVER w AS next_id FROM latest WINDOW w AS (PARTITION BY knowledge_id ORDER BY n)),
entries AS (
  SELECT knowledge_id, id, old_id, next_id, 'file' AS rec_kind, unnest(from_json(coalesce(d->'files', '[]'), '["JSON"]')) AS e FROM linked
  UNION ALL SELECT knowledge_id, id, old_id, next_id, 'chunk', unnest(from_json(coalesce(d->'chunks', '[]'), '["JSON"]')) FROM linked),
rows AS (
  SELECT knowledge_id, id, old_id, next_id, rec_kind, CASE rec_kind WHEN 'file' THEN e->>'file_id' ELSE e->>'id' END AS rec_id,
    list_sort(list(DISTINCT CASE rec_kind WHEN 'file' THEN {_fields('filename', 'directory_id')} ELSE {_fields('file_id', 'chunk_index', 'content_hash', 'token_count')} END)) AS f
  FROM entries GROUP BY ALL HAVING rec_id IS NOT NULL),
new AS (SELECT * FROM rows WHERE old_id IS NOT NULL), old AS (SELECT * FROM rows WHERE next_id IS NOT NULL)
SELECT DISTINCT coalesce(new.knowledge_id, old.knowledge_id) AS knowledge_id, coalesce(new.id, old.next_id) AS snapshot_id,
  coalesce(new.rec_kind, old.rec_kind) AS rec_kind, coalesce(new.rec_id, old.rec_id) AS rec_id,
  CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'changed' END AS delta
FROM new FULL JOIN old ON new.id = old.next_id AND new.rec_kind = old.rec_kind AND new.rec_id = old.rec_id
WHERE new.f IS DISTINCT FROM old.f OR new.id IS NULL OR old.id IS NULL"""

SQL = {
    "p1_found": _P1,
    "p1_report": f"SELECT child_table, period, reason, count(*) AS n_records FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_counts": f"SELECT knowledge_id, snapshot_id, rec_kind, delta, count(*) AS n_records FROM ({_P2}) GROUP BY ALL",
}
