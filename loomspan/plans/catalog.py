"""Queries over catalogues, trees, progress and deltas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_ref, strip
from ..operators import catalog as C
from ..operators import messages as M
from ..operators import tree as T
from ..operators.chunk_table import latest
from ..sources.tables import read_table as t
from ..streaming import progress as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_REF = r"nullif(regexp_replace(lower({}), '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '')"
_FILES = f"files AS (SELECT * REPLACE ({_REF.format('id')} AS id) FROM file_record QUALIFY row_number() OVER (PARTITION BY {_REF.format('id')} ORDER BY updated_at DESC, created_at DESC, filename) = 1)"
_LINKS = f"links AS (SELECT DISTINCT knowledge_id, {_REF.format('file_id')} AS file_id FROM knowledge_chunk WHERE {_REF.format('file_id')} IS NOT NULL)"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Each file once, as delivered last."""
    return latest(t(spark, folder, "file_record").withColumn("id", norm_ref(F.col("id"))), ["id"], [F.desc("updated_at"), F.desc("created_at"), F.col("filename")])


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Which files a knowledge base has, by its chunks."""
    return t(spark, folder, "knowledge_chunk").select("knowledge_id", norm_ref(F.col("file_id")).alias("file_id")).where("file_id IS NOT NULL").distinct()


@query("SELECT id, name FROM knowledge WHERE coalesce(name ILIKE '%a%', false) OR coalesce(description ILIKE '%a%', false)")
def kb_search(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "knowledge").where(C.contains_any("a", "name", "description")).select("id", "name")


@query("SELECT id, name, updated_at FROM knowledge ORDER BY updated_at DESC, id LIMIT 30")
def kb_list_page(spark: SparkSession, folder: str) -> DataFrame:
    return C.page(t(spark, folder, "knowledge").select("id", "name", "updated_at"), [F.desc("updated_at"), F.col("id")], 0, 30)


@query("SELECT id, updated_at FROM knowledge ORDER BY updated_at DESC, id LIMIT 5 OFFSET 5")
def kb_second_page(spark: SparkSession, folder: str) -> DataFrame:
    return C.page(t(spark, folder, "knowledge").select("id", "updated_at"), [F.desc("updated_at"), F.col("id")], 5, 5)


@query(f"WITH {_LINKS} SELECT k.id, count(l.file_id) AS n_files FROM knowledge k LEFT JOIN links l ON l.knowledge_id = k.id GROUP BY 1")
def kb_file_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = _links(spark, folder).groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n"))
    kbs = t(spark, folder, "knowledge").select("id")
    return kbs.join(counts, kbs["id"] == counts["knowledge_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_files"))


@query(f"WITH {_FILES}, {_LINKS} SELECT f.id, f.filename, l.knowledge_id, k.name AS kb_name FROM files f JOIN links l ON l.file_id = f.id JOIN knowledge k ON k.id = l.knowledge_id WHERE f.filename ILIKE '%notes%'")
def files_search_all(spark: SparkSession, folder: str) -> DataFrame:
    """A file in several knowledge bases gives a row for each."""
    f = _files(spark, folder).where(F.col("filename").ilike("%notes%")).select("id", "filename")
    k = t(spark, folder, "knowledge").select(F.col("id").alias("knowledge_id"), F.col("name").alias("kb_name"))
    links = _links(spark, folder)
    return f.join(links, f["id"] == links["file_id"]).join(k, "knowledge_id").select("id", "filename", "knowledge_id", "kb_name")


@query(f"WITH {_FILES}, {_LINKS} SELECT l.knowledge_id, f.id, f.filename, row_number() OVER (PARTITION BY l.knowledge_id ORDER BY f.updated_at DESC, f.id) AS place FROM files f JOIN links l ON l.file_id = f.id QUALIFY place <= 50")
def kb_files_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first page (50) of the files of every knowledge base, the latest first."""
    f, links = _files(spark, folder).select("id", "filename", "updated_at"), _links(spark, folder)
    by = W.partitionBy("knowledge_id").orderBy(F.desc("updated_at"), "id")
    return f.join(links, f["id"] == links["file_id"]).withColumn("place", F.row_number().over(by)).where("place <= 50").select("knowledge_id", "id", "filename", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_FILES} SELECT id, filename FROM files WHERE filename LIKE '%.md'")
def files_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).where(F.col("filename").like(C.glob("*.md"))).select("id", "filename")


@query(f"WITH {_FILES} SELECT user_id, count(*) AS n_files FROM files GROUP BY 1")
def files_count(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {_LINKS} SELECT file_id, count(*) AS n_kbs, min(knowledge_id) AS first_kb FROM links JOIN knowledge k ON k.id = links.knowledge_id GROUP BY 1")
def kbs_by_file(spark: SparkSession, folder: str) -> DataFrame:
    kbs = t(spark, folder, "knowledge").select(F.col("id").alias("knowledge_id"))
    return _links(spark, folder).join(kbs, "knowledge_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_kbs"), F.min("knowledge_id").alias("first_kb"))


_GRANTS = "grants AS (SELECT DISTINCT knowledge_id AS resource_id, user_id AS grantee FROM knowledge_relevance_judgment WHERE user_id IS NOT NULL)"


@query(f"WITH {_GRANTS} SELECT k.id, coalesce(k.user_id = 'user-0017', false) OR g.resource_id IS NOT NULL AS write_access FROM knowledge k LEFT JOIN grants g ON g.resource_id = k.id AND g.grantee = 'user-0017'")
def write_access(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a user owns a knowledge base or has judged in it (which stands for a grant here)."""
    grants = t(spark, folder, "knowledge_relevance_judgment").where(F.col("user_id") == "user-0017").select(F.col("knowledge_id").alias("g")).distinct()
    k = t(spark, folder, "knowledge").select("id", "user_id")
    return k.join(grants, k["id"] == grants["g"], "left").select("id", (F.coalesce(F.col("user_id") == "user-0017", F.lit(False)) | F.col("g").isNotNull()).alias("write_access"))


@query(f"WITH {_GRANTS} SELECT id, name FROM knowledge WHERE user_id = 'user-0017' OR id IN (SELECT resource_id FROM grants WHERE grantee = 'user-0017')")
def kb_readable(spark: SparkSession, folder: str) -> DataFrame:
    grants = t(spark, folder, "knowledge_relevance_judgment").select(F.col("knowledge_id").alias("resource_id"), F.col("user_id").alias("grantee")).distinct()
    return C.readable(t(spark, folder, "knowledge").select("id", "name", "user_id"), grants, "user-0017").select("id", "name")


@query("SELECT hash, count(*) AS n_files, min(id) AS first_id FROM (SELECT DISTINCT id, hash FROM file_record) GROUP BY 1")
def files_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "file_record").select("id", "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_files"), F.min("id").alias("first_id"))


_TASKS = f"tasks AS (SELECT * REPLACE ({_REF.format('file_id')} AS file_id) FROM knowledge_processing_task QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC) = 1)"


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "knowledge_processing_task").withColumn("file_id", norm_ref(F.col("file_id")))
    return latest(rows, ["id"], [F.desc("updated_at"), F.desc("created_at")])


@query(f"WITH {_TASKS}, {_LINKS} SELECT DISTINCT knowledge_id, file_id, 'pending' AS state FROM tasks WHERE status = 'pending' AND file_id IS NOT NULL UNION ALL SELECT knowledge_id, file_id, 'listed' FROM links ANTI JOIN (SELECT knowledge_id, file_id FROM tasks WHERE status = 'pending') p USING (knowledge_id, file_id)")
def pending_union(spark: SparkSession, folder: str) -> DataFrame:
    """Files that wait, then the listed ones that don't."""
    waiting = _tasks(spark, folder).where("status = 'pending' AND file_id IS NOT NULL").select("knowledge_id", "file_id").distinct()
    listed = _links(spark, folder).join(waiting, ["knowledge_id", "file_id"], "left_anti")
    return waiting.withColumn("state", F.lit("pending")).unionByName(listed.withColumn("state", F.lit("listed")))


@query(f"WITH {_FILES}, {_LINKS} SELECT id FROM files WHERE id NOT IN (SELECT file_id FROM links)")
def batch_new_files(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder).select(F.col("file_id").alias("id")).distinct()
    return _files(spark, folder).select("id").join(links, "id", "left_anti")


@query("SELECT id FROM knowledge WHERE meta IS NULL OR CASE WHEN json_valid(meta) THEN meta->>'source' END <> 'external'")
def source_local_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A knowledge base whose meta names no source is left out: the comparison is NULL."""
    return t(spark, folder, "knowledge").where(C.is_local(F.col("meta"))).select("id")


@query(f"WITH {_FILES}, {_LINKS} SELECT l.knowledge_id, regexp_replace(k.name, '[^\\pL\\pN _-]', '_', 'g') AS folder, CASE WHEN ends_with(f.filename, '.txt') THEN f.filename ELSE f.filename || '.txt' END AS entry FROM links l JOIN files f ON f.id = l.file_id JOIN knowledge k ON k.id = l.knowledge_id")
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    f, links = _files(spark, folder).select(F.col("id").alias("file_id"), "filename"), _links(spark, folder)
    k = t(spark, folder, "knowledge").select(F.col("id").alias("knowledge_id"), "name")
    entry = F.when(F.col("filename").endswith(".txt"), F.col("filename")).otherwise(F.concat("filename", F.lit(".txt")))
    return links.join(f, "file_id").join(k, "knowledge_id").select("knowledge_id", C.safe_name(F.col("name")).alias("folder"), entry.alias("entry"))


@query(f"""WITH {_FILES}, c AS (SELECT id, filename, CASE WHEN json_valid(meta) THEN meta->>'content_type' END AS ct FROM files)
SELECT id, CASE WHEN regexp_matches(ct, '^(image|video)/') AND regexp_matches(filename, '(?i)\\.(txt|md|csv|json|ya?ml|log|py|ts|js)$') THEN 'process' WHEN starts_with(ct, 'audio/') THEN 'transcribe' WHEN starts_with(ct, 'video/') THEN 'skip' WHEN starts_with(ct, 'image/') THEN 'error' ELSE 'process' END AS route FROM c""")
def content_type_route(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder).select("id", C.content_route(F.get_json_object("meta", "$.content_type"), F.col("filename")).alias("route"))


# Trees: the source names of documents as paths


_DIRS = """paths AS (SELECT DISTINCT replace(source, '-', '/') AS path FROM documents WHERE source IS NOT NULL),
dirs AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS id FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM paths)),
nodes AS (SELECT id, nullif(regexp_extract(id, '^(.*)/[^/]*$', 1), '') AS parent_id, regexp_extract(id, '([^/]*)$', 1) AS name FROM dirs)"""
_UP = f"""WITH RECURSIVE {_DIRS}, up AS (SELECT id, id AS ancestor_id, parent_id AS p, 0::BIGINT AS distance FROM nodes UNION ALL SELECT u.id, n.id, n.parent_id, u.distance + 1 FROM up u JOIN nodes n ON n.id = u.p)"""


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "documents").where("source IS NOT NULL").select(F.replace("source", F.lit("-"), F.lit("/")).alias("path")).distinct()


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return T.tree_of_paths(_paths(spark, folder), "path")


@query(f"{_UP} SELECT up.id, string_agg(n.name, '/' ORDER BY distance DESC) AS path, max(distance) AS depth FROM up JOIN nodes n ON n.id = up.ancestor_id GROUP BY 1")
def dir_paths(spark: SparkSession, folder: str) -> DataFrame:
    return T.full_paths(_nodes(spark, folder))


@query(f"{_UP} SELECT id, ancestor_id, distance FROM up")
def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    return T.ancestors(_nodes(spark, folder))


@query("SELECT x AS id FROM (VALUES ('a'), ('b')) v(x)")
def dir_cycle_check(spark: SparkSession, folder: str) -> DataFrame:
    """The tree with a cycle of two added: only its nodes are found."""
    odd = spark.createDataFrame([("a", "b", "a"), ("b", "a", "b"), ("c", "gone", "c")], "id string, parent_id string, name string")
    return T.in_cycle(_nodes(spark, folder).unionByName(odd))


@query(f"{_UP}, sub AS (SELECT id FROM up WHERE ancestor_id = 'feed/manuals') SELECT doc_id, CASE WHEN replace(source, '-', '/') IN (SELECT id FROM sub) THEN 'feed' ELSE replace(source, '-', '/') END AS directory FROM documents WHERE source IS NOT NULL")
def dir_delete_move(spark: SparkSession, folder: str) -> DataFrame:
    """A directory is deleted and the documents of its subtree move to its parent."""
    sub = T.ancestors(_nodes(spark, folder)).where("ancestor_id = 'feed/manuals'").select(F.col("id").alias("path"))
    docs = t(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", F.replace("source", F.lit("-"), F.lit("/")).alias("path"))
    return docs.join(sub.withColumn("gone", F.lit(True)), "path", "left").select("doc_id", F.when(F.col("gone"), "feed").otherwise(F.col("path")).alias("directory"))


@query(f"{_UP}, sub AS (SELECT id FROM up WHERE ancestor_id = 'feed/manuals') SELECT doc_id FROM documents WHERE source IS NOT NULL AND replace(source, '-', '/') NOT IN (SELECT id FROM sub)")
def dir_delete_files(spark: SparkSession, folder: str) -> DataFrame:
    sub = T.ancestors(_nodes(spark, folder)).where("ancestor_id = 'feed/manuals'").select(F.col("id").alias("path"))
    docs = t(spark, folder, "documents").where("source IS NOT NULL").select("doc_id", F.replace("source", F.lit("-"), F.lit("/")).alias("path"))
    return docs.join(sub, "path", "left_anti").select("doc_id")


_SYNC = """m AS (SELECT filename AS key, max(sha256(text)) AS checksum FROM documents WHERE filename IS NOT NULL GROUP BY 1),
x AS (SELECT filename AS key, max(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END) AS checksum FROM documents WHERE filename IS NOT NULL AND lang IS NOT NULL GROUP BY 1 UNION ALL SELECT 'gone_' || id, NULL FROM knowledge)"""


@query(f"WITH {_SYNC} SELECT coalesce(m.key, x.key) AS key, CASE WHEN x.key IS NULL THEN 'added' WHEN m.key IS NULL THEN 'deleted' WHEN m.checksum = x.checksum THEN 'unmodified' ELSE 'modified' END AS state FROM m FULL JOIN x ON m.key = x.key")
def sync_files_diff(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of all documents against an index that lacks unlabelled ones, has stale or no checksums, and names files that are gone."""
    docs = t(spark, folder, "documents").where("filename IS NOT NULL")
    manifest = docs.groupBy(F.col("filename").alias("key")).agg(F.max(F.sha2("text", 256)).alias("checksum"))
    old = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, "old").otherwise(F.sha2("text", 256))
    indexed = docs.where("lang IS NOT NULL").groupBy(F.col("filename").alias("key")).agg(F.max(old).alias("checksum"))
    gone = t(spark, folder, "knowledge").select(F.concat(F.lit("gone_"), "id").alias("key"), F.lit(None).cast("string").alias("checksum"))
    return T.sync_diff(manifest, indexed.unionByName(gone))


@query(f"WITH {_DIRS} SELECT id AS path, len(string_split(id, '/')) AS depth FROM dirs WHERE id NOT IN (SELECT array_to_string(list_slice(string_split(replace(source, '-', '/'), '/'), 1, 2), '/') FROM documents WHERE lang = 'en' AND source IS NOT NULL)")
def sync_mkdir(spark: SparkSession, folder: str) -> DataFrame:
    """Directories that the documents need and the English ones' second level doesn't give."""
    there = t(spark, folder, "documents").where("lang = 'en' AND source IS NOT NULL").select(F.array_join(F.slice(F.split("source", "-"), 1, 2), "/").alias("path")).distinct()
    need = _nodes(spark, folder).select(F.col("id").alias("path"))
    return need.join(there, "path", "left_anti").select("path", F.size(F.split("path", "/")).cast("bigint").alias("depth"))


@query(f"WITH {_DIRS}, need AS (SELECT DISTINCT unnest([replace(source, '-', '/'), regexp_extract(replace(source, '-', '/'), '^(.*)/[^/]*$', 1), 'feed']) AS id FROM documents WHERE lang = 'en' AND source IS NOT NULL) SELECT id AS path FROM dirs WHERE id NOT IN (SELECT id FROM need)")
def sync_rmdir(spark: SparkSession, folder: str) -> DataFrame:
    """Directories that no English document needs, itself or below."""
    kept = T.tree_of_paths(t(spark, folder, "documents").where("lang = 'en' AND source IS NOT NULL").select(F.replace("source", F.lit("-"), F.lit("/")).alias("path")), "path").select("id")
    return _nodes(spark, folder).select("id").join(kept, "id", "left_anti").select(F.col("id").alias("path"))


@query(f"WITH {_LINKS}, {_FILES}, gone AS (SELECT {_REF.format('entity_id')} AS id FROM deletion_log WHERE entity = 'file'), h AS (SELECT hash FROM files WHERE id IN (SELECT id FROM gone) AND hash IS NOT NULL) SELECT DISTINCT knowledge_id, file_id FROM links l LEFT JOIN files f ON f.id = l.file_id WHERE l.file_id NOT IN (SELECT id FROM gone) AND (f.hash IS NULL OR f.hash NOT IN (SELECT hash FROM h))")
def sync_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Links that stay when the logged files are removed by id and by hash."""
    gone = t(spark, folder, "deletion_log").where("entity = 'file'").select(norm_ref(F.col("entity_id")).alias("file_id")).distinct()
    files = _files(spark, folder).select(F.col("id").alias("file_id"), "hash")
    hashes = files.join(gone, "file_id", "left_semi").where("hash IS NOT NULL").select("hash").distinct()
    rest = _links(spark, folder).join(gone, "file_id", "left_anti").join(files, "file_id", "left")
    return rest.join(hashes, "hash", "left_anti").select("knowledge_id", "file_id").distinct()


# Progress and streams

_EV = "ev AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, least(value, 100.0) AS pct FROM events)"
_STATE = "state AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(pct, (ts, event_id)) AS pct, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM ev GROUP BY 1)"


@query(f"WITH {_EV}, {_STATE} SELECT user_id, status, pct, n_events FROM state")
def progress_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return P.progress_of(t(spark, folder, "events")).select("user_id", "status", "pct", "n_events")


@query(f"WITH {_EV}, {_STATE} SELECT status, count(*) AS n_tasks, round(avg(pct), 4) AS mean_pct FROM state GROUP BY 1")
def progress_summary(spark: SparkSession, folder: str) -> DataFrame:
    return P.progress_of(t(spark, folder, "events")).groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("pct"), 4).alias("mean_pct"))


@query(f"WITH {_EV}, {_STATE} SELECT count(*) AS n_tasks, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS n_ended, coalesce(bool_and(status IN ('completed', 'failed')), false) AS all_done FROM state")
def progress_terminal(spark: SparkSession, folder: str) -> DataFrame:
    return P.all_done(P.progress_of(t(spark, folder, "events")))


@query(f"WITH {_TASKS} SELECT knowledge_id, id, status, created_at FROM tasks QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id) = 1")
def batch_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest(_tasks(spark, folder), ["knowledge_id"], [F.desc("created_at"), F.col("id")]).select("knowledge_id", "id", "status", "created_at")


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.windowed_counts(t(spark, folder, "events"))
    return rows.select(F.col("w.start").cast("date").alias("day"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events")
def sse_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Events as server-sent lines, every fifth of them ``[DONE]``, parsed again."""
    line = F.when(F.col("event_id") % 5 == 0, "data: [DONE]").otherwise(F.concat(F.lit("data: "), "props"))
    return t(spark, folder, "events").select("event_id", F.get_json_object(M.parse_sse(line), "$.k").cast("bigint").alias("k"))


@query("SELECT user_id, string_agg(event_type || ';', '' ORDER BY ts, event_id) AS body, count(*) AS n_deltas FROM events GROUP BY 1")
def delta_concat(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "events").withColumn("body", F.concat("event_type", F.lit(";")))
    return M.concat_deltas(rows, ["user_id"], ["ts", "event_id"], "body")


@query("""WITH r AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r),
n AS (SELECT *, row_number() OVER x AS k, lead(event_id) OVER x AS later FROM g WINDOW x AS (PARTITION BY user_id, run ORDER BY ts, event_id))
SELECT user_id, run::BIGINT AS run, (k - 1) // 3 AS batch, event_id FROM n WHERE later IS NULL OR k % 3 = 0""")
def delta_batches(spark: SparkSession, folder: str) -> DataFrame:
    return M.batch_deltas(t(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", 3).select("user_id", "run", "batch", "event_id")


@query("SELECT user_id, event_type, arg_max(props, (event_id)) AS name, string_agg(coalesce(props, ''), '' ORDER BY event_id) AS arguments FROM events GROUP BY ALL")
def tool_call_assemble(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "events").select("user_id", "event_type", "event_id", F.col("props").alias("name"), F.col("props").alias("arguments"))
    return M.assemble_calls(rows, ["user_id", "event_type"], "event_id")


@query("SELECT id, c[len(c)].text AS text FROM (SELECT id, list_filter(context_chunks, lambda x: x.text IS NOT NULL AND x.text <> '') AS c FROM golden_set) WHERE len(c) > 0")
def last_output_text(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.filter("context_chunks", lambda x: x["text"].isNotNull() & (x["text"] != ""))
    return t(spark, folder, "golden_set").select("id", kept.alias("c")).where(F.size("c") > 0).select("id", F.element_at("c", -1)["text"].alias("text"))


@query(f"WITH {_TASKS} SELECT knowledge_id, count(*) AS n_tasks, count(DISTINCT file_id) AS n_files, round(100 * count(*) FILTER (WHERE status = 'completed') / count(*)) AS pct_done, coalesce(sum(chunks_total), 0)::BIGINT AS chunks FROM tasks GROUP BY 1")
def batch_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tasks(spark, folder)
    return rows.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("file_id").alias("n_files"), F.round(100 * F.count_if(F.col("status") == "completed") / F.count(F.lit(1))).alias("pct_done"), F.coalesce(F.sum("chunks_total"), F.lit(0)).cast("bigint").alias("chunks"))


@query("""WITH m AS (SELECT user_id, event_id AS pos, event_type AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT user_id, props AS name, CASE WHEN event_id % 3 = 0 THEN 'data:x' ELSE 'f/' || event_id END AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT m.user_id, m.pos, CASE WHEN url IS NULL OR starts_with(url, 'data:') THEN '' ELSE '<file name="' || coalesce(name, '') || '" url="' || url || '"/>' || chr(10) END || content AS content FROM m LEFT JOIN s ON s.user_id = m.user_id AND s.n = m.n""")
def message_file_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as messages, their purchases as stored files, joined by position."""
    e = t(spark, folder, "events")
    said = e.where("event_type != 'error'").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("content"))
    url = F.when(F.col("event_id") % 3 == 0, "data:x").otherwise(F.concat(F.lit("f/"), F.col("event_id")))
    stored = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pos"), F.col("props").alias("name"), url.alias("url"))
    return M.file_tags(said, stored, "user_id")


@query("SELECT k.id, k.name, coalesce(s.n, 0) AS n_steps, s.first_role FROM knowledge k LEFT JOIN (SELECT knowledge_id, count(*) AS n, arg_min(task_type, (created_at, id)) AS first_role FROM (SELECT DISTINCT knowledge_id, id, created_at, task_type FROM knowledge_processing_task) GROUP BY 1) s ON s.knowledge_id = k.id")
def workflow_steps_list(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge bases as workflows, their tasks as steps in order of time."""
    tasks = t(spark, folder, "knowledge_processing_task").select(F.col("knowledge_id").alias("workflow_id"), F.struct("created_at", "id").alias("order_index"), F.col("task_type").alias("agent_role")).distinct()
    rows = M.steps_of(t(spark, folder, "knowledge").select("id", "name"), tasks)
    return rows.select("id", "name", F.size("steps").cast("bigint").alias("n_steps"), F.get("steps", F.lit(0))["agent_role"].alias("first_role"))
