"""Queries that search, page and change the catalogue, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_ref
from ..operators import mutations as U
from ..operators import search as S
from ..sources.tables import read_table as t
from .catalog import _FILES, _LINKS, _REF, _files, _links

QUERIES: dict = {}
SQL: dict[str, str] = {}
ME, GROUPS = "user-0017", ["g3", "g8"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_USERS = "users AS (SELECT 'user-' || lpad(c_custkey::VARCHAR, 4, '0') AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email, lower(c_mktsegment) || c_custkey AS username FROM customer)"
_OWNED = f"{_USERS}, owned AS (SELECT k.*, u.name AS user_name, u.email AS user_email, u.username FROM knowledge k LEFT JOIN users u ON u.id = k.user_id)"
_ANY = "(coalesce(name ILIKE '%{0}%', false) OR coalesce(description ILIKE '%{0}%', false) OR coalesce(user_name ILIKE '%{0}%', false) OR coalesce(user_email ILIKE '%{0}%', false) OR coalesce(username ILIKE '%{0}%', false))"
_GRANTS = "grants AS (SELECT DISTINCT knowledge_id AS resource_id, 'user' AS kind, user_id AS grantee, CASE WHEN relevance = 1 THEN 'write' ELSE 'read' END AS permission FROM knowledge_relevance_judgment WHERE user_id IS NOT NULL UNION ALL SELECT id, 'group', 'g' || (substr(id, 4)::INT % 10), 'read' FROM knowledge)"
_MAY = f"coalesce(user_id = '{ME}', false) OR id IN (SELECT resource_id FROM grants WHERE (kind = 'user' AND grantee = '{ME}') OR (kind = 'group' AND grantee IN ('g3', 'g8')))"


def _users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users."""
    number, name = F.col("c_custkey").cast("string"), F.col("c_name")
    return t(spark, folder, "customer").select(F.concat(F.lit("user-"), F.lpad(number, 4, "0")).alias("id"), name.alias("name"), F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"), F.concat(F.lower("c_mktsegment"), number).alias("username"))


def _grants(spark: SparkSession, folder: str) -> DataFrame:
    """Judging stands for a grant to a user, a number in the id for one to a group."""
    judged = t(spark, folder, "knowledge_relevance_judgment").where("user_id IS NOT NULL")
    own = judged.select(F.col("knowledge_id").alias("resource_id"), F.lit("user").alias("kind"), F.col("user_id").alias("grantee"), F.when(F.col("relevance") == 1, "write").otherwise("read").alias("permission")).distinct()
    group = F.concat(F.lit("g"), (F.substring("id", 4, 20).cast("int") % 10).cast("string"))
    return own.unionByName(t(spark, folder, "knowledge").select(F.col("id").alias("resource_id"), F.lit("group").alias("kind"), group.alias("grantee"), F.lit("read").alias("permission")))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of knowledge bases with a directory: the first sign of the id, none for digits."""
    sign = F.substring("id", 1, 1)
    f = _files(spark, folder).withColumn("directory_id", F.when(~sign.rlike("[0-9]"), F.concat(F.lit("dir-"), sign)))
    return _links(spark, folder).join(f, F.col("file_id") == f["id"]).drop("file_id")


_PLACED = f"{_FILES}, {_LINKS}, placed AS (SELECT l.knowledge_id, f.*, CASE WHEN NOT regexp_matches(substr(f.id, 1, 1), '[0-9]') THEN 'dir-' || substr(f.id, 1, 1) END AS directory_id FROM links l JOIN files f ON f.id = l.file_id)"


@query(f"WITH {_OWNED} SELECT id, user_name, username FROM owned WHERE {_ANY.format('in')}")
def kb_search_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge bases by a text in their five searched columns, the owner's included."""
    return S.search_bases(t(spark, folder, "knowledge"), _users(spark, folder), "in").select("id", "user_name", "username")


@query(f"WITH {_OWNED}, {_GRANTS}, f AS (SELECT * FROM owned WHERE {_ANY.format('a')} AND ({_MAY})) SELECT id, name, updated_at, user_email FROM f ORDER BY updated_at DESC, id LIMIT 4 OFFSET 4")
def kb_search_page(spark: SparkSession, folder: str) -> DataFrame:
    """Search, access and order composed; the second page of four."""
    found = S.accessible(S.search_bases(t(spark, folder, "knowledge"), _users(spark, folder), "a"), _grants(spark, folder), ME, GROUPS)
    return S.paged(found, [F.desc("updated_at"), F.col("id")], 2, 4)[0].select("id", "name", "updated_at", "user_email")


@query(f"WITH {_OWNED}, {_GRANTS} SELECT count(*) AS total FROM owned WHERE {_ANY.format('a')} AND ({_MAY})")
def kb_search_total(spark: SparkSession, folder: str) -> DataFrame:
    found = S.accessible(S.search_bases(t(spark, folder, "knowledge"), _users(spark, folder), "a"), _grants(spark, folder), ME, GROUPS)
    return S.paged(found, [F.col("id")])[1]


@query(f"SELECT 'created' AS view, id FROM knowledge WHERE user_id = '{ME}' UNION ALL SELECT 'shared', id FROM knowledge WHERE user_id <> '{ME}'")
def kb_views(spark: SparkSession, folder: str) -> DataFrame:
    k = t(spark, folder, "knowledge")
    return reduce(DataFrame.unionByName, [S.viewed(k, v, ME).select(F.lit(v).alias("view"), "id") for v in ("created", "shared")])


@query("SELECT id FROM knowledge WHERE json_valid(meta) AND meta->>'source' = 'external'")
def source_external_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.of_source(t(spark, folder, "knowledge"), "external").select("id")


@query(f"WITH {_GRANTS}, p(permission) AS (VALUES ('read'), ('write'), ('admin')) SELECT p.permission, k.id FROM p, knowledge k WHERE p.permission = 'admin' OR coalesce(k.user_id = '{ME}', false) OR k.id IN (SELECT resource_id FROM grants g WHERE ((kind = 'user' AND grantee = '{ME}') OR (kind = 'group' AND grantee IN ('g3', 'g8'))) AND (p.permission = 'read' OR g.permission = 'write'))")
def kb_access(spark: SparkSession, folder: str) -> DataFrame:
    """What a user may read and write, and what an admin may."""
    k, g = t(spark, folder, "knowledge").select("id", "user_id"), _grants(spark, folder)
    parts = [S.accessible(k, g, ME, GROUPS, "write" if p == "write" else "read", p == "admin").select(F.lit(p).alias("permission"), "id") for p in ("read", "write", "admin")]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {_FILES}, {_LINKS}, {_USERS}, text AS (SELECT file_id AS id, string_agg(content, ' ' ORDER BY chunk_index, content) AS content FROM (SELECT DISTINCT {_REF.format('file_id')} AS file_id, chunk_index, content FROM knowledge_chunk WHERE content IS NOT NULL) WHERE file_id IS NOT NULL GROUP BY 1) SELECT f.id, f.filename, l.knowledge_id, u.name AS user_name FROM files f JOIN links l ON l.file_id = f.id JOIN knowledge k ON k.id = l.knowledge_id LEFT JOIN users u ON u.id = f.user_id LEFT JOIN text x ON x.id = f.id WHERE coalesce(f.filename ILIKE '%guide%', false) OR coalesce(x.content ILIKE '%glossary%', false)")
def files_search_content(spark: SparkSession, folder: str) -> DataFrame:
    """Files by name or whole content, with their owner; a row for each knowledge base they are in."""
    rows = t(spark, folder, "knowledge_chunk").where("content IS NOT NULL").select("file_id", "chunk_index", "content")
    rows = rows.withColumn("file_id", norm_ref(F.col("file_id"))).where("file_id IS NOT NULL").distinct()
    hit = rows.where(F.col("content").ilike("%glossary%")).select(F.col("file_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    f = _files(spark, folder).join(hit, "id", "left").where(F.coalesce(F.col("filename").ilike("%guide%"), F.lit(False)) | F.col("_hit"))
    links = _links(spark, folder).join(t(spark, folder, "knowledge").select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_semi")
    return S.with_owner(f.join(links, f["id"] == links["file_id"]), _users(spark, folder)).select("id", "filename", "knowledge_id", "user_name")


@query(f"WITH {_PLACED} SELECT 'all' AS scope, count(*) AS n, min(id) AS first_id FROM placed UNION ALL SELECT 'dir-b', count(*), min(id) FROM placed WHERE directory_id = 'dir-b' UNION ALL SELECT 'none', count(*), min(id) FROM placed WHERE directory_id IS NULL")
def directory_scope(spark: SparkSession, folder: str) -> DataFrame:
    rows = _placed(spark, folder).select("knowledge_id", "id", "directory_id")
    scopes = {"all": {}, "dir-b": {"directory_id": "dir-b"}, "none": {"directory_id": None}}
    return reduce(DataFrame.unionByName, [S.in_directory(rows, s).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).select(F.lit(n).alias("scope"), "n", "first_id") for n, s in scopes.items()])


_ORDERS = {("name", "asc"): "filename", ("name", "down"): "filename DESC", ("created_at", "asc"): "created_at", ("created_at", "desc"): "created_at DESC", ("updated_at", "asc"): "updated_at", ("size", "asc"): "updated_at DESC"}


@query(f"WITH {_PLACED} " + " UNION ALL ".join(f"SELECT '{a}' AS order_by, '{b}' AS direction, knowledge_id, id, row_number() OVER (PARTITION BY knowledge_id ORDER BY {o} NULLS {'LAST' if 'DESC' in o else 'FIRST'}, id) AS place FROM placed QUALIFY place <= 50" for (a, b), o in _ORDERS.items()))
def files_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of each knowledge base's files in every order; unknown keys fall back to the default."""
    rows = _placed(spark, folder).select("knowledge_id", "id", "filename", "created_at", "updated_at")
    out = []
    for key, direction in _ORDERS:
        place = F.row_number().over(W.partitionBy("knowledge_id").orderBy(*S.file_order(key, direction)))
        out.append(rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= S.FILE_PAGE).select(F.lit(key).alias("order_by"), F.lit(direction).alias("direction"), "knowledge_id", "id", "place"))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {_PLACED} SELECT knowledge_id, count(*) AS n_files FROM placed WHERE filename ILIKE '%a%' GROUP BY 1")
def files_light_count(spark: SparkSession, folder: str) -> DataFrame:
    """Counted over the joins, without order and wide columns."""
    return _placed(spark, folder).where(F.col("filename").ilike("%a%")).groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {_PLACED} SELECT knowledge_id, id, directory_id, user_id, created_at FROM placed")
def files_with_directory(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select("knowledge_id", "id", "directory_id", "user_id", "created_at")


@query(f"WITH {_FILES} SELECT id, hash, CASE WHEN json_valid(meta) THEN meta->>'name' END AS name, CASE WHEN json_valid(meta) THEN meta->>'content_type' END AS content_type, created_at, updated_at FROM files")
def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Files without their data."""
    return _files(spark, folder).select("id", "hash", F.get_json_object("meta", "$.name").alias("name"), F.get_json_object("meta", "$.content_type").alias("content_type"), "created_at", "updated_at")


@query("SELECT id, user_id, name, description, meta, created_at, updated_at FROM knowledge WHERE id = 'kb-0000003'")
def kb_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "knowledge").where("id = 'kb-0000003'")


@query(f"WITH {_LINKS}, {_FILES} SELECT f.id, bool_or(coalesce(l.knowledge_id = 'kb-0000012', false)) AS has_file FROM files f LEFT JOIN links l ON l.file_id = f.id GROUP BY 1")
def kb_has_file(spark: SparkSession, folder: str) -> DataFrame:
    inside = _links(spark, folder).where("knowledge_id = 'kb-0000012'").select(F.col("file_id").alias("id"), F.lit(True).alias("_in"))
    return _files(spark, folder).select("id").join(inside, "id", "left").select("id", F.coalesce("_in", F.lit(False)).alias("has_file"))


@query(f"WITH {_FILES}, gone AS (SELECT DISTINCT {_REF.format('entity_id')} AS id FROM deletion_log WHERE entity = 'file') SELECT id FROM gone WHERE id NOT IN (SELECT id FROM files)")
def missing_file_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Asked-for ids without a file."""
    asked = t(spark, folder, "deletion_log").where("entity = 'file'").select(norm_ref(F.col("entity_id")).alias("id")).distinct()
    return asked.join(_files(spark, folder).select("id"), "id", "left_anti")


# Changes


_KB = ["id", "user_id", "name", "updated_at"]


@query("SELECT id, user_id, name, updated_at FROM knowledge UNION ALL SELECT 'new-' || id, user_id, name, 7 FROM knowledge WHERE user_id IS NOT NULL")
def kb_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of owned knowledge bases under new ids; rows under ids that exist are refused."""
    k = t(spark, folder, "knowledge").select(*_KB)
    new = k.where("user_id IS NOT NULL").withColumn("id", F.concat(F.lit("new-"), "id")).withColumn("updated_at", F.lit(7).cast("bigint"))
    return U.insert_rows(k, new.unionByName(k).unionByName(new), ["id"])


@query("SELECT id, user_id, CASE WHEN user_id IS NULL THEN name || '!' ELSE name END AS name, CASE WHEN user_id IS NULL THEN 9 ELSE updated_at END AS updated_at FROM knowledge")
def kb_update(spark: SparkSession, folder: str) -> DataFrame:
    k = t(spark, folder, "knowledge").select(*_KB)
    changed = k.where("user_id IS NULL").select("id", F.concat("name", F.lit("!")).alias("name"))
    return U.update_rows(k, changed, ["id"], F.lit(9).cast("bigint"))


_GONE_KB = "(SELECT id FROM knowledge WHERE user_id IS NULL)"


@query(f"WITH {_LINKS} SELECT 'knowledge' AS tab, id AS key FROM knowledge WHERE user_id IS NOT NULL UNION ALL SELECT 'link', knowledge_id || '/' || file_id FROM links WHERE knowledge_id NOT IN {_GONE_KB} UNION ALL SELECT DISTINCT 'task', id FROM knowledge_processing_task WHERE knowledge_id NOT IN {_GONE_KB} OR knowledge_id IS NULL")
def kb_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge bases without owner go, with all that belongs to them."""
    k = t(spark, folder, "knowledge")
    bases, links, tasks = U.delete_bases(k, [_links(spark, folder), t(spark, folder, "knowledge_processing_task").select("knowledge_id", "id").distinct()], k.where("user_id IS NULL"))
    return bases.select(F.lit("knowledge").alias("tab"), F.col("id").alias("key")).union(links.select(F.lit("link"), F.concat_ws("/", "knowledge_id", "file_id"))).union(tasks.select(F.lit("task"), "id").distinct())


@query(f"WITH {_LINKS} SELECT id, CASE WHEN user_id IS NULL THEN 9 ELSE updated_at END AS updated_at, (SELECT count(*) FROM links l WHERE l.knowledge_id = k.id AND k.user_id IS NOT NULL) AS n_links FROM knowledge k")
def kb_reset(spark: SparkSession, folder: str) -> DataFrame:
    k = t(spark, folder, "knowledge").select(*_KB)
    bases, links = U.reset_base(k, _links(spark, folder), k.where("user_id IS NULL"), F.lit(9).cast("bigint"))
    n = links.groupBy(F.col("knowledge_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return bases.join(n, "id", "left").select("id", "updated_at", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(f"WITH {_LINKS}, {_FILES} SELECT knowledge_id, file_id FROM links UNION SELECT 'kb-0000012', id FROM files")
def file_link(spark: SparkSession, folder: str) -> DataFrame:
    """All files linked to one knowledge base; what is linked already stays as it is."""
    new = _files(spark, folder).select(F.lit("kb-0000012").alias("knowledge_id"), F.col("id").alias("file_id"))
    return U.insert_rows(_links(spark, folder), new, ["knowledge_id", "file_id"])


@query(f"WITH {_LINKS}, {_FILES} SELECT 'file' AS tab, id AS key FROM files WHERE hash IS NOT NULL UNION ALL SELECT 'link', knowledge_id || '/' || file_id FROM links WHERE file_id NOT IN (SELECT id FROM files WHERE hash IS NULL)")
def file_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Files without hash are deleted everywhere: from the table and from every knowledge base."""
    f, links = _files(spark, folder), _links(spark, folder)
    gone = f.where("hash IS NULL").select("id")
    return U.delete_rows(f, gone, [("id", "id")]).select(F.lit("file").alias("tab"), F.col("id").alias("key")).union(U.delete_rows(links, gone, [("file_id", "id")]).select(F.lit("link"), F.concat_ws("/", "knowledge_id", "file_id")))


_CH = f"c AS (SELECT DISTINCT id, knowledge_id, {_REF.format('file_id')} AS file_id, content FROM knowledge_chunk WHERE file_id IS NOT NULL)"


@query(f"WITH {_CH}, b AS (SELECT DISTINCT knowledge_id, file_id FROM c WHERE length(content) > 1000 AND file_id IS NOT NULL) SELECT id, knowledge_id, file_id, content FROM c ANTI JOIN b USING (knowledge_id, file_id) UNION ALL SELECT 'v2-' || id, knowledge_id, file_id, '# ' || content FROM c SEMI JOIN b USING (knowledge_id, file_id)")
def file_content_swap(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a long chunk get new texts: their new vectors are added before the old ones go."""
    c = t(spark, folder, "knowledge_chunk").where("file_id IS NOT NULL").select("id", "knowledge_id", norm_ref(F.col("file_id")).alias("file_id"), "content").distinct()
    files = c.where("length(content) > 1000 AND file_id IS NOT NULL").select("knowledge_id", "file_id").distinct()
    new = c.join(files, ["knowledge_id", "file_id"], "left_semi").withColumn("id", F.concat(F.lit("v2-"), "id")).withColumn("content", F.concat(F.lit("# "), "content"))
    return U.swap_vectors(c, new)


@query(f"WITH {_PLACED} SELECT DISTINCT id, CASE WHEN ends_with(filename, '.md') THEN 'renamed_' || filename ELSE filename END AS filename, CASE WHEN directory_id = 'dir-b' THEN 'dir-c' ELSE directory_id END AS directory_id, CASE WHEN directory_id = 'dir-b' THEN 9 ELSE updated_at END AS updated_at FROM placed")
def file_rename_move(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files get another name; those of one directory move, which counts as an update."""
    f = _placed(spark, folder).select("id", "filename", "directory_id", "updated_at").distinct()
    named = f.where(F.col("filename").endswith(".md")).select("id", F.concat(F.lit("renamed_"), "filename").alias("filename"), "updated_at")
    moved = f.where("directory_id = 'dir-b'").select("id", F.lit("dir-c").alias("directory_id"))
    return U.update_rows(U.update_rows(f, named, ["id"], F.col("updated_at")), moved, ["id"], F.lit(9).cast("bigint"))


@query(f"WITH {_FILES}, u AS (SELECT id, hash, CASE WHEN json_valid(meta) THEN (meta->>'size')::BIGINT END AS size, regexp_extract(filename, '([^/\\\\]*)$', 1) AS base FROM files) SELECT id, base AS filename, lower(regexp_extract(base, '\\.([^.]*)$', 1)) AS extension, hash, CASE WHEN lower(regexp_extract(base, '\\.([^.]*)$', 1)) NOT IN ('md', 'txt', 'pdf') THEN 'type' WHEN size > 200000 THEN 'size' ELSE 'pending' END AS status FROM u")
def file_upload(spark: SparkSession, folder: str) -> DataFrame:
    """How each file is recorded when uploaded, with allowed types and a size limit."""
    size = F.get_json_object("meta", "$.size").cast("bigint")
    return _files(spark, folder).select("id", U.upload_row(F.col("filename"), F.col("hash"), size, ["md", "txt", "pdf"], 200_000).alias("u")).select("id", "u.*")


@query("SELECT id, CASE WHEN coalesce(description, '') <> '' THEN name || chr(10) || chr(10) || description ELSE name END AS text FROM knowledge")
def kb_metadata_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each knowledge base's metadata vector."""
    return t(spark, folder, "knowledge").select("id", U.metadata_text(F.col("name"), F.col("description")).alias("text"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(name, '') <> '' AND user_id IS NOT NULL) AS success FROM knowledge")
def kb_metadata_reindex(spark: SparkSession, folder: str) -> DataFrame:
    """How many knowledge bases there are and how many got a metadata vector (those with name and owner)."""
    return t(spark, folder, "knowledge").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.coalesce("name", F.lit("")) != "") & F.col("user_id").isNotNull()).alias("success"))


@query(f"WITH {_LINKS}, {_FILES} SELECT l.knowledge_id, count(f.id) AS done, count(*) - count(f.id) AS failed, min(CASE WHEN f.id IS NULL THEN l.file_id END) AS first_failed FROM links l LEFT JOIN files f ON f.id = l.file_id GROUP BY 1")
def kb_reindex_files(spark: SparkSession, folder: str) -> DataFrame:
    """A rebuild of all links: files that are gone fail and are reported, the others go on."""
    f = _files(spark, folder).select(F.col("id").alias("fid"))
    rows = _links(spark, folder).join(f, F.col("file_id") == F.col("fid"), "left")
    lost = F.col("fid").isNull()
    return rows.groupBy("knowledge_id").agg(F.count("fid").alias("done"), F.count_if(lost).alias("failed"), F.min(F.when(lost, F.col("file_id"))).alias("first_failed"))


@query(f"SELECT id, array_to_string(list_transform(list_filter(context_chunks, lambda x: x.source IS NULL OR NOT ends_with(x.source, '.pdf')), lambda x: coalesce(x.source, '-')), ',') AS sources FROM golden_set WHERE context_chunks IS NOT NULL")
def model_reference_removal(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of sources after those that end in .pdf are gone everywhere; the rest keeps its order."""
    g = t(spark, folder, "golden_set").where("context_chunks IS NOT NULL").select("id", F.transform("context_chunks", lambda x: F.struct(x["source"].alias("id"))).alias("refs"))
    gone = g.select(F.explode("refs").alias("r")).select(F.col("r.id").alias("id")).where(F.col("id").endswith(".pdf")).distinct()
    return U.without_reference(g, "refs", gone).select("id", F.array_join(F.transform("refs", lambda x: F.coalesce(x["id"], F.lit("-"))), ",").alias("sources"))


@query(f"SELECT DISTINCT directory_id, count(*) AS n_files FROM (WITH {_PLACED} SELECT DISTINCT id, directory_id FROM placed) WHERE directory_id IS NOT NULL GROUP BY 1 ORDER BY 1")
def directories_list(spark: SparkSession, folder: str) -> DataFrame:
    """Directories by name."""
    rows = _placed(spark, folder).where("directory_id IS NOT NULL").select("id", "directory_id").distinct()
    return rows.groupBy("directory_id").agg(F.count(F.lit(1)).alias("n_files")).orderBy("directory_id")
