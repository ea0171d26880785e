"""Queries over files as bytes, directories, snapshots, external sources, progress and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import chunk_table as K
from ..operators import external as X
from ..operators import mutations as U
from ..operators import tree as T
from ..sources import files as S
from ..sources.tables import read_table as t
from ..streaming import progress as P
from .catalog import _TASKS, _tasks
from .knowledge import _CUR, _REF, norm_ref
from .library import _PLACED, _placed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Files as bytes


@query("SELECT doc_id, text, CASE WHEN text = '' THEN NULL ELSE 'utf-8' END AS encoding FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0 UNION ALL SELECT doc_id, '手册' || doc_id, 'gbk' FROM documents WHERE doc_id % 3 = 0")
def text_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes read as UTF-8, else as GBK; an empty text counts as unread."""
    d = t(spark, folder, "documents")
    gbk = F.concat(F.unhex(F.lit("CAD6B2E1")), F.encode(F.col("doc_id").cast("string"), "US-ASCII"))
    raw = d.where("doc_id % 3 = 0").select("doc_id", gbk.alias("raw")).unionByName(d.where("doc_id % 3 > 0 AND text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("raw")))
    read = raw.select(F.col("doc_id").cast("string").alias("path"), F.length("raw").cast("bigint").alias("size"), F.col("raw").alias("content")).mapInArrow(S._decode_batches, "path string, size bigint, text string, encoding string")
    return read.select(F.col("path").cast("bigint").alias("doc_id"), "text", F.when(F.col("text") != "", F.col("encoding")).alias("encoding"))


@query("SELECT doc_id, coalesce(text, '') <> '' AND doc_id % 7 > 0 AS is_text FROM documents")
def text_sniff(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes with a zero among the first 8,192 or without any are no text."""
    zero = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return t(spark, folder, "documents").select("doc_id", S.is_text(F.concat(zero, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("is_text"))


@query("SELECT filename AS path, regexp_extract(filename, '([^/]*)$', 1) AS name, sha256(coalesce(text, '')) AS checksum, strlen(coalesce(text, ''))::BIGINT AS size FROM documents WHERE filename IS NOT NULL AND NOT regexp_matches(filename, '(^|/)\\.') AND doc_id % 9 > 0")
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files below a folder: checksum and size of those that aren't hidden."""
    d = t(spark, folder, "documents").where("filename IS NOT NULL")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(".git/"), "filename")).otherwise(F.col("filename"))
    raw = d.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return S.manifest_of(raw).select("path", F.col("filename").alias("name"), "checksum", "size")


@query("SELECT id, question, golden_answer, kb_id, coalesce(len(context_chunks), 0) AS n_context FROM golden_set")
def golden_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The golden set written as JSON texts and read with its schema."""
    g = t(spark, folder, "golden_set")
    text = F.to_json(F.struct(*[F.col(c) for c in g.columns]))
    return g.select(F.from_json(text, S.GOLDEN).alias("g")).select("g.id", "g.question", "g.golden_answer", "g.kb_id", F.coalesce(F.size("g.context_chunks"), F.lit(0)).cast("bigint").alias("n_context"))


@query("SELECT DISTINCT filename, length(text) AS n_chars FROM documents WHERE filename IS NOT NULL AND text IS NOT NULL")
def documents_map_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of texts by file name, a map a document, as rows."""
    d = t(spark, folder, "documents").where("filename IS NOT NULL AND text IS NOT NULL")
    rows = d.select(F.to_json(F.create_map("filename", "text")).alias("value"))
    return S.map_entries(rows).select("filename", F.length("text").cast("bigint").alias("n_chars")).distinct()


@query("SELECT doc_id, coalesce(text, '') AS content, CASE WHEN filename IS NULL THEN 'attachment' WHEN ends_with(filename, '.pdf') OR ends_with(filename, '.txt') THEN 'inline' ELSE 'attachment' END AS disposition FROM documents")
def file_content(spark: SparkSession, folder: str) -> DataFrame:
    """What serving a file's data gives: its text, empty where there is none."""
    name = F.col("filename")
    return t(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.when(name.endswith(".pdf") | name.endswith(".txt"), "inline").otherwise("attachment").alias("disposition"))


@query("SELECT source, filename || CASE WHEN ends_with(filename, '.txt') THEN '' ELSE '.txt' END AS entry, length(text) AS n_chars FROM documents WHERE filename IS NOT NULL AND coalesce(text, '') <> ''")
def export_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the exported archives: files without content are skipped."""
    d = t(spark, folder, "documents").where("filename IS NOT NULL AND coalesce(text, '') != ''")
    return d.select("source", F.concat("filename", F.when(F.col("filename").endswith(".txt"), "").otherwise(".txt")).alias("entry"), F.length("text").cast("bigint").alias("n_chars"))


# Directories


_DIR = f"{_PLACED}, d AS (SELECT knowledge_id || '/' || directory_id AS id, knowledge_id, CASE WHEN directory_id <> 'dir-a' THEN knowledge_id || '/dir-a' END AS parent_id, directory_id AS name, min(created_at) AS created_at FROM placed WHERE directory_id IS NOT NULL GROUP BY ALL)"


def _dirs(spark: SparkSession, folder: str) -> DataFrame:
    """Directories of each knowledge base: dir-a holds the others."""
    rows = _placed(spark, folder).where("directory_id IS NOT NULL").groupBy("knowledge_id", "directory_id").agg(F.min("created_at").alias("created_at"))
    own = F.concat_ws("/", "knowledge_id", "directory_id")
    parent = F.when(F.col("directory_id") != "dir-a", F.concat("knowledge_id", F.lit("/dir-a")))
    return rows.select(own.alias("id"), "knowledge_id", parent.alias("parent_id"), F.col("directory_id").alias("name"), "created_at")


@query(f"WITH {_DIR} SELECT id, parent_id, name FROM d UNION ALL SELECT 'new/' || id, parent_id, 'x' || name FROM d UNION ALL SELECT 'again/' || id, NULL, name FROM d WHERE parent_id IS NULL")
def directory_create(spark: SparkSession, folder: str) -> DataFrame:
    """New directories: other names are taken, a name its parent has is refused, roots never collide."""
    d = _dirs(spark, folder)
    later = (F.col("created_at") + 1).alias("created_at")
    new = d.select(F.concat(F.lit("new/"), "id").alias("id"), "knowledge_id", "parent_id", F.concat(F.lit("x"), "name").alias("name"), later)
    again = d.select(F.concat(F.lit("again/"), "id").alias("id"), "knowledge_id", "parent_id", "name", later)
    return T.named_once(d.unionByName(new).unionByName(again)).select("id", "parent_id", "name")


@query(f"WITH {_DIR} SELECT id, CASE WHEN name = 'dir-b' THEN NULL WHEN name = 'dir-c' AND EXISTS (SELECT 1 FROM d e WHERE e.id = d.knowledge_id || '/dir-d') THEN knowledge_id || '/dir-d' ELSE parent_id END AS parent_id FROM d")
def directory_move(spark: SparkSession, folder: str) -> DataFrame:
    """dir-b moves to the root, dir-c below dir-d; dir-a can't move below its own child, nothing moves below what isn't there."""
    d = _dirs(spark, folder)
    target = F.when(F.col("name") == "dir-c", F.concat("knowledge_id", F.lit("/dir-d"))).when(F.col("name") == "dir-a", F.concat("knowledge_id", F.lit("/dir-e"))).when(F.col("name") == "dir-f", "nowhere")
    moves = d.where("name IN ('dir-a', 'dir-b', 'dir-c', 'dir-f')").select("id", target.alias("target"))
    child = d.where("name = 'dir-e'").select("id")
    below = moves.where("target LIKE '%/dir-e'").join(child.withColumnRenamed("id", "target"), "target", "left_semi")
    return T.moved(d, moves.where("target IS NULL OR target NOT LIKE '%/dir-e'").unionByName(below.select("id", "target"))).select("id", "parent_id")


@query(f"WITH {_DIR} SELECT id, 'old ' || name AS name, created_at FROM d WHERE name < 'dir-c' UNION ALL SELECT id, name, created_at FROM d WHERE name >= 'dir-c'")
def directory_rename(spark: SparkSession, folder: str) -> DataFrame:
    d = _dirs(spark, folder).select("id", "name", "created_at")
    return U.update_rows(d, d.where("name < 'dir-c'").select("id", F.concat(F.lit("old "), "name").alias("name")), ["id"], F.lit(0))


# Snapshots


@query(f"""WITH {_CUR}, {_PLACED}, c AS (SELECT knowledge_id, count(*) AS chunk_count, string_agg(id || ':' || coalesce(content_hash, '∅') || ':' || coalesce(token_count::VARCHAR, ''), ',' ORDER BY id) AS chunks FROM cur GROUP BY 1),
f AS (SELECT knowledge_id, count(*) AS file_count, string_agg(id || ':' || filename || ':' || coalesce(directory_id, ''), ',' ORDER BY id) AS files FROM placed GROUP BY 1)
SELECT k.id AS knowledge_id, coalesce(file_count, 0) AS file_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(files, '') AS files, coalesce(chunks, '') AS chunks FROM knowledge k LEFT JOIN c ON c.knowledge_id = k.id LEFT JOIN f ON f.knowledge_id = k.id""")
def snapshot_document(spark: SparkSession, folder: str) -> DataFrame:
    """The document of a new snapshot of every knowledge base, read again as its fields."""
    made = K.snapshot_documents(t(spark, folder, "knowledge").select(F.col("id").alias("knowledge_id")), _placed(spark, folder).select("knowledge_id", F.col("id").alias("file_id"), "filename", "directory_id"), K.current_chunks(t(spark, folder, "knowledge_chunk")))
    doc = F.from_json("snapshot_data", "files array<struct<file_id:string,filename:string,directory_id:string>>, chunks array<struct<id:string,content_hash:string,token_count:bigint>>")
    told = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), ",")
    part = lambda *x: F.concat_ws(":", *x)
    files = told(F.col("d.files"), lambda x: part(x["file_id"], x["filename"], F.coalesce(x["directory_id"], F.lit(""))))
    chunks = told(F.col("d.chunks"), lambda x: part(x["id"], F.coalesce(x["content_hash"], F.lit("∅")), F.coalesce(x["token_count"].cast("string"), F.lit(""))))
    return made.withColumn("d", doc).select("knowledge_id", "file_count", "chunk_count", files.alias("files"), chunks.alias("chunks"))


@query("SELECT knowledge_id, id, label, file_count, coalesce(chunk_count, 0) AS chunk_count, created_at FROM knowledge_snapshot WHERE id = (SELECT min(id) FROM knowledge_snapshot)")
def snapshot_get(spark: SparkSession, folder: str) -> DataFrame:
    s = t(spark, folder, "knowledge_snapshot")
    first = s.agg(F.min("id").alias("id"))
    return s.join(first, "id", "left_semi").select("knowledge_id", "id", "label", "file_count", F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"), "created_at")


@query("SELECT DISTINCT knowledge_id, id FROM knowledge_snapshot WHERE chunk_count IS NOT NULL AND knowledge_id IS NOT NULL")
def snapshot_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots without a chunk count are deleted."""
    s = t(spark, folder, "knowledge_snapshot").where("knowledge_id IS NOT NULL").select("knowledge_id", "id", "chunk_count").distinct()
    return U.delete_rows(s, s.where("chunk_count IS NULL"), [("id", "id")]).select("knowledge_id", "id").distinct()


@query(f"""WITH {_CUR}, s AS (SELECT knowledge_id, id, created_at, from_json(snapshot_data, '{{"chunks":[{{"id":"VARCHAR","file_id":"VARCHAR","chunk_index":"BIGINT","content_hash":"VARCHAR"}}]}}') AS d FROM knowledge_snapshot WHERE json_valid(snapshot_data)),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id DESC) = 1), c AS (SELECT knowledge_id, unnest(d.chunks) AS c FROM l)
SELECT DISTINCT knowledge_id, c.id AS id, c.file_id AS file_id, '' AS content FROM c WHERE c.id IS NOT NULL UNION ALL SELECT knowledge_id, id, file_id, content FROM cur WHERE knowledge_id NOT IN (SELECT knowledge_id FROM l)""")
def snapshot_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks after each knowledge base went back to its latest snapshot: its chunks without text; bases without snapshot keep theirs."""
    doc = F.from_json("snapshot_data", "chunks array<struct<id:string,file_id:string>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    whole = t(spark, folder, "knowledge_snapshot").select("knowledge_id", "id", "created_at", doc.alias("d")).where("d IS NOT NULL AND d._bad IS NULL")
    last = K.latest(whole, ["knowledge_id"], [F.desc("created_at"), F.desc("id")])
    old = last.select("knowledge_id", F.explode("d.chunks").alias("c")).select("knowledge_id", "c.id", "c.file_id", F.lit("").alias("content")).where("id IS NOT NULL").distinct()
    now = K.current_chunks(t(spark, folder, "knowledge_chunk")).select("knowledge_id", "id", "file_id", "content")
    return now.join(last.select("knowledge_id"), "knowledge_id", "left_anti").unionByName(old)


# External sources


_CONN = "conn AS (SELECT *, user_id, CASE substr(id, 10, 1)::INT % 4 WHEN 0 THEN ' Qdrant' WHEN 1 THEN 'milvus' WHEN 2 THEN 'PGVECTOR ' ELSE 'other' END AS provider, substr(id, 10, 1)::INT AS n FROM knowledge)"


def _conn(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("id", 10, 1).cast("int")
    provider = F.when(n % 4 == 0, " Qdrant").when(n % 4 == 1, "milvus").when(n % 4 == 2, "PGVECTOR ").otherwise("other")
    return t(spark, folder, "knowledge").withColumn("n", n).withColumn("provider", provider)


@query(f"WITH {_CONN}, e AS (SELECT id, n, lower(trim(provider)) AS p, CASE WHEN n % 4 = 3 THEN 'Unsupported external knowledge provider.' WHEN user_id IS NULL THEN 'Knowledge source name is required.' WHEN n = 8 THEN 'Knowledge source endpoint is required.' END AS error FROM conn) SELECT id, p AS provider, error, CASE WHEN error IS NULL THEN CASE WHEN p = 'milvus' THEN 'db_name,timeout' ELSE 'timeout' END END AS keys FROM e")
def connection_check(spark: SparkSession, folder: str) -> DataFrame:
    config = F.create_map(F.lit("timeout"), F.lit("9"), F.lit("db_name"), F.lit("d"), F.lit("secret"), F.lit("s"))
    c = X.valid_connection(F.col("provider"), F.col("user_id"), F.when(F.col("n") == 8, " ").otherwise("http://x"), config)
    return _conn(spark, folder).select("id", c.alias("c")).select("id", "c.provider", "c.error", F.array_join(F.array_sort(F.map_keys("c.config")), ",").alias("keys"))


@query(f"WITH {_CONN}, e AS (SELECT id, n, name, lower(trim(provider)) AS p, CASE WHEN n = 4 THEN 'Only collection sources are supported.' WHEN n % 4 = 3 OR n = 8 THEN 'Content field is required.' WHEN n IN (5, 6) THEN 'Vector field is required.' END AS error FROM conn) SELECT id, trim(name) AS name, error, CASE WHEN error IS NULL THEN CASE p WHEN 'pgvector' THEN 'content_field=body,table_name=t,vector_field=v' ELSE 'content_field=body,vector_field=v' END END AS config FROM e")
def source_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of sources: stripped, blank and foreign ones left out, what is required checked."""
    n = F.col("n")
    config = F.create_map(F.lit("content_field"), F.when(n == 8, "  ").otherwise(" body "), F.lit("vector_field"), F.when(n.isin(5, 6), "").otherwise("v"), F.lit("table_name"), F.lit("t"), F.lit("drop"), F.lit("x"))
    s = X.normal_source(F.when(n == 4, "file").when(n == 1, " collection "), F.concat(F.lit(" "), "name", F.lit(" ")), config, F.lower(strip(F.col("provider"))))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("s.config")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return _conn(spark, folder).select("id", s.alias("s")).select("id", "s.name", "s.error", shown.alias("config"))


@query(f"WITH {_CONN} SELECT id, provider, n > 4 AS auth_configured FROM conn")
def connections_list(spark: SparkSession, folder: str) -> DataFrame:
    """Connections as they are listed, without secrets."""
    secret = F.when(F.col("n") > 4, F.create_map(F.lit("key"), F.lit("s")))
    return X.shown_connections(_conn(spark, folder).select("id", "provider", secret.alias("auth_config")))


@query("SELECT coalesce(user_id, '-') AS connection_id, count(*) AS n_bases FROM knowledge GROUP BY 1")
def connection_use(spark: SparkSession, folder: str) -> DataFrame:
    """How many knowledge bases each connection serves (owners stand for connections)."""
    meta = F.to_json(F.struct(F.struct(F.coalesce("user_id", F.lit("-")).alias("connection_id")).alias("external")))
    return X.mapped_to(t(spark, folder, "knowledge").select(meta.alias("meta")))


@query("SELECT id, coalesce(CASE WHEN json_valid(meta) THEN meta->>'source' END = 'external', false) AS read_only FROM knowledge")
def external_guard(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "knowledge").select("id", F.coalesce(F.get_json_object("meta", "$.source") == "external", F.lit(False)).alias("read_only"))


# Progress


_UP = "u AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN (props->>'k')::BIGINT END AS chunks_total, CASE WHEN event_id % 5 = 0 THEN event_id END AS chunks_processed, CASE WHEN event_type = 'error' THEN props END AS error_message FROM events)"


@query(f"WITH {_UP} SELECT user_id % 7 AS knowledge_id, user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS pct, arg_max(chunks_total, (ts, event_id)) FILTER (WHERE chunks_total IS NOT NULL) AS chunks_total, arg_max(chunks_processed, (ts, event_id)) FILTER (WHERE chunks_processed IS NOT NULL) AS chunks_processed, arg_max(error_message, (ts, event_id)) FILTER (WHERE error_message IS NOT NULL) AS error_message FROM u GROUP BY ALL")
def progress_optional(spark: SparkSession, folder: str) -> DataFrame:
    """Progress by knowledge base and file: status and percent always, three more fields only where they are given."""
    n = F.col("event_id")
    rows = t(spark, folder, "events").select((F.col("user_id") % 7).alias("knowledge_id"), "user_id", "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("pct"), F.when(n % 3 == 0, F.get_json_object("props", "$.k").cast("bigint")).alias("chunks_total"), F.when(n % 5 == 0, n).alias("chunks_processed"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"))
    out = P.upsert(rows, ["knowledge_id", "user_id"], ["ts", "event_id"], ["status", "pct"], ["chunks_total", "chunks_processed", "error_message"])
    return out.select("knowledge_id", "user_id", "status", "pct", "chunks_total", "chunks_processed", "error_message")


@query("WITH s AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), e AS (SELECT user_id, min(n) AS stop FROM s WHERE event_type IN ('purchase', 'error') GROUP BY 1) SELECT s.user_id, count(*) AS n_sends, max(CASE WHEN n = stop THEN event_type END) AS ended FROM s LEFT JOIN e USING (user_id) WHERE n <= coalesce(stop, n) GROUP BY 1")
def file_status_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What a status stream of each file sends until it has ended."""
    rows = t(spark, folder, "events").select("user_id", "ts", "event_id", P.state_of(F.col("event_type")).alias("status"), "event_type")
    sent = P.until_ended(rows, ["user_id"], ["ts", "event_id"])
    return sent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sends"), F.max(F.when(F.col("status").isin(*P.TERMINAL), F.col("event_type"))).alias("ended"))


@query(f"WITH {_TASKS} SELECT knowledge_id, count(*) AS n_pending, min(created_at) AS oldest FROM tasks WHERE status IN ('pending', 'chunking', 'embedding') GROUP BY 1")
def pending_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream of waiting files shows; a knowledge base without any has ended."""
    return _tasks(spark, folder).where(F.col("status").isin("pending", "chunking", "embedding")).groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("n_pending"), F.min("created_at").alias("oldest"))


@query(f"WITH {_TASKS} SELECT id, 'table' AS origin FROM tasks WHERE status <> 'failed' UNION ALL SELECT id, 'memory' FROM tasks WHERE status = 'failed'")
def tasks_with_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of the table, and those in memory that the table lacks (all are in memory, failed ones only there)."""
    rows = _tasks(spark, folder).select("id", "status")
    stored, memory = rows.where("status != 'failed'").select("id", F.lit("table").alias("origin")), rows.select("id", F.lit("memory").alias("origin"))
    return stored.unionByName(memory.join(stored, "id", "left_anti"))


@query("SELECT user_id, min(epoch_us(ts)) FILTER (WHERE event_type <> 'signup') - min(epoch_us(ts)) AS first_us FROM events GROUP BY 1")
def first_byte(spark: SparkSession, folder: str) -> DataFrame:
    """Time from a stream's start to its first event that says something."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, folder, "events").groupBy("user_id").agg((F.min(F.when(F.col("event_type") != "signup", at)) - F.min(at)).alias("first_us"))


# Evaluation and reports


@query(f"WITH r AS (SELECT DISTINCT knowledge_id, query_text, {_REF.format('chunk_id')} AS chunk_id, relevance, created_at, id FROM knowledge_relevance_judgment) SELECT knowledge_id, query_text, array_to_string(list(id || ':' || coalesce(relevance::VARCHAR, '') ORDER BY created_at DESC, id), ',') AS judgments, count(*) AS n FROM r GROUP BY ALL")
def judgments_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's judgments as a list, the latest first."""
    r = t(spark, folder, "knowledge_relevance_judgment").select("knowledge_id", "query_text", norm_ref(F.col("chunk_id")).alias("chunk_id"), "relevance", "created_at", "id").distinct()
    place = F.array_sort(F.collect_list(F.struct((-F.col("created_at")).alias("o"), "id", "relevance")))
    shown = F.transform(place, lambda x: F.concat(x["id"], F.lit(":"), F.coalesce(x["relevance"].cast("string"), F.lit(""))))
    return r.groupBy("knowledge_id", "query_text").agg(F.array_join(shown, ",").alias("judgments"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT run_no, result_id, faithfulness, refusal, coalesce(len(claims), 0) AS n FROM eval_result)
SELECT run_no, 0 AS line_no, '# Evaluation ' || run_no || ': ' || printf('%.4f', coalesce(round(avg(faithfulness), 4), 0)) AS line FROM r GROUP BY 1
UNION ALL SELECT run_no, row_number() OVER (PARTITION BY run_no ORDER BY result_id), '- ' || result_id || ': ' || CASE WHEN refusal THEN 'refusal' ELSE n || ' claims' END FROM r""")
def report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown report of each run: its mean, then a line an item."""
    r = t(spark, folder, "eval_result").select("run_no", "result_id", "faithfulness", "refusal", F.coalesce(F.size("claims"), F.lit(0)).alias("n")).distinct()
    head = r.groupBy("run_no").agg(F.coalesce(F.round(F.avg("faithfulness"), 4), F.lit(0.0)).alias("m")).select("run_no", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("# Evaluation "), "run_no", F.lit(": "), F.format_string("%.4f", F.col("m"))).alias("line"))
    what = F.when(F.col("refusal"), "refusal").otherwise(F.concat("n", F.lit(" claims")))
    place = F.row_number().over(W.partitionBy("run_no").orderBy("result_id")).cast("bigint")
    return head.unionByName(r.select("run_no", place.alias("line_no"), F.concat(F.lit("- "), "result_id", F.lit(": "), what).alias("line")))


@query("WITH l AS (SELECT result_id, unnest(range(0, len(string_split(answer, chr(10))))) AS n, regexp_replace(unnest(string_split(answer, chr(10))), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS line FROM (SELECT DISTINCT result_id, answer FROM eval_result WHERE answer IS NOT NULL)) SELECT result_id, n, line FROM l WHERE line <> ''")
def report_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of a rendered report: the stripped lines that aren't blank."""
    rows = t(spark, folder, "eval_result").where("answer IS NOT NULL").select("result_id", "answer").distinct().select("result_id", F.posexplode(F.split("answer", "\n")).alias("n", "line"))
    return rows.select("result_id", F.col("n").cast("bigint").alias("n"), strip(F.col("line")).alias("line")).where("line != ''")


@query("SELECT knowledge_id, query_text, CASE WHEN recall > 0.8 THEN 'green' WHEN recall > 0.5 THEN 'yellow' ELSE 'red' END AS recall_mark, CASE WHEN hit / 10 > 0.7 THEN 'green' WHEN hit / 10 > 0.4 THEN 'yellow' ELSE 'red' END AS precision_mark FROM (SELECT knowledge_id, query_text, hit, round(hit / n, 4) AS recall FROM (SELECT knowledge_id, query_text, count(DISTINCT CASE WHEN relevance = 1 THEN coalesce(chunk_id, '∅') END) AS n, count(DISTINCT CASE WHEN relevance = 1 AND rank_position BETWEEN 1 AND 10 THEN chunk_id END) AS hit FROM knowledge_relevance_judgment GROUP BY ALL) WHERE n > 0)")
def metric_marks(spark: SparkSession, folder: str) -> DataFrame:
    from .knowledge import eval_metrics

    def mark(c: str, high: float, low: float) -> Column:
        return F.when(F.col(c) > high, "green").when(F.col(c) > low, "yellow").otherwise("red")

    return eval_metrics(spark, folder).select("knowledge_id", "query_text", mark("recall", 0.8, 0.5).alias("recall_mark"), mark("precision", 0.7, 0.4).alias("precision_mark"))


@query("WITH s AS (SELECT knowledge_id, id, created_at, from_json(snapshot_data, '{\"files\":[{\"file_id\":\"VARCHAR\"}]}') AS d FROM knowledge_snapshot WHERE json_valid(snapshot_data)), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at, id) = 1), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id DESC) = 1) SELECT knowledge_id, unnest(d.files).file_id AS file_id FROM a INTERSECT SELECT knowledge_id, unnest(d.files).file_id FROM b")
def snapshot_common(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a knowledge base's first and last snapshot share."""
    from .knowledge import _ends

    ids = [d.select("knowledge_id", F.explode("d.files").alias("f")).select("knowledge_id", "f.file_id") for d in _ends(spark, folder)]
    return ids[0].intersect(ids[1])


@query("SELECT k.id, coalesce(g.grants, '') AS grants FROM knowledge k LEFT JOIN (SELECT knowledge_id, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS grants FROM knowledge_relevance_judgment WHERE user_id IS NOT NULL GROUP BY 1) g ON g.knowledge_id = k.id")
def kb_with_grants(spark: SparkSession, folder: str) -> DataFrame:
    """Each knowledge base with the users that may see it."""
    g = t(spark, folder, "knowledge_relevance_judgment").where("user_id IS NOT NULL").groupBy(F.col("knowledge_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("user_id")), ",").alias("grants"))
    return t(spark, folder, "knowledge").select("id").join(g, "id", "left").select("id", F.coalesce("grants", F.lit("")).alias("grants"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'think_tags' WHEN 'view' THEN 'reasoning_content' END AS format FROM events")
def reasoning_format(spark: SparkSession, folder: str) -> DataFrame:
    """How reasoning is handed to a provider."""
    provider = F.when(F.col("event_type") == "click", "ollama").when(F.col("event_type") == "view", "llama.cpp").otherwise("other")
    return t(spark, folder, "events").select("event_id", F.when(provider == "ollama", "think_tags").when(provider == "llama.cpp", "reasoning_content").alias("format"))
