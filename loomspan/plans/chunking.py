"""Chunking queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..sources.tables import read_table

_STRIP = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_OUT = "length(content) // 4 AS token_count, sha256(content) AS content_hash"


def _chunked(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return C.chunk_documents(read_table(spark, folder, "documents"), method)

    return run


def chunk_dispatch_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").where(F.length("text") > 0)
    return docs.groupBy(C.table_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def chunk_table_csv(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").where((F.length("text") > 0) & (C.table_kind(F.col("text")) == "csv"))
    return docs.select("doc_id", F.explode(C.csv_rows(F.col("text"))).alias("p")).select("doc_id", F.col("p.title").cast("bigint").alias("row"), F.col("p.content").alias("content"))


def chunk_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return C.keywords(read_table(spark, folder, "documents"))


def chunk_questions(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(C.questions(F.col("text"))).alias("i", "question")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("n"), "question")


def chunk_enrich(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "knowledge_chunk").where(F.col("content").isNotNull())
    real, count = F.sha2("content", 256), C.token_count(F.col("content"))
    return chunks.select("id", count.alias("token_count"), real.alias("content_hash"), F.col("content_hash").eqNullSafe(real).alias("hash_fresh"), F.col("token_count").eqNullSafe(count).alias("count_right"), C.questions(F.col("content"), 1)[0].alias("question")).distinct()


def chunk_dedup_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f"chunk_{m}": _chunked(m) for m in ("naive", "general", "book", "paper", "resume", "table", "qa")} | {
    f.__name__: f for f in (chunk_dispatch_stats, chunk_table_csv, chunk_keywords, chunk_questions, chunk_enrich, chunk_dedup_hash)
}

_D = "(SELECT doc_id, text FROM documents WHERE length(text) > 0)"
_GENERAL = f"""
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM {_D}),
w AS (SELECT doc_id, p, 1 AS i, 0 AS c, 1 AS lo, length(p[1]) AS n FROM p WHERE len(p) > 0
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN n + length(p[i + 1]) > 1000 THEN c + 1 ELSE c END, CASE WHEN n + length(p[i + 1]) > 1000 THEN i ELSE lo END,
    CASE WHEN n + length(p[i + 1]) > 1000 THEN length(p[i]) + length(p[i + 1]) ELSE n + length(p[i + 1]) END FROM w WHERE i < len(p)),
general AS (SELECT doc_id, c::BIGINT AS chunk_index, (max(i) - max(lo) + 1)::VARCHAR AS title, array_to_string(list_slice(any_value(p), max(lo), max(i)), chr(10) || chr(10)) AS content FROM w GROUP BY doc_id, c)"""


def _sectioned(words: list[str], within: int, least: int) -> str:
    heads = " OR ".join(f"contains(lower(line), '{w}')" for w in words)
    return f"""
WITH RECURSIVE {_GENERAL},
l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, {_STRIP.format('unnest(s)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {_D})),
h AS (SELECT *, ({heads}) AND length(line) < {within} AS head FROM l),
k AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
s AS (SELECT doc_id, sec, coalesce(max(line) FILTER (WHERE head), '{C.NO_SECTION}') AS title, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> '') AS content FROM k GROUP BY doc_id, sec),
found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_index, title, content FROM s WHERE length(content) > {least})
SELECT *, {_OUT} FROM (SELECT * FROM found UNION ALL SELECT * FROM general WHERE doc_id NOT IN (SELECT doc_id FROM found))"""


_BOOK = f"""
WITH RECURSIVE {_GENERAL},
l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}) AS s FROM {_D}),
b AS (SELECT doc_id, s, 0 AS i, 0 AS sec, 0 AS n, NULL::VARCHAR AS title, NULL::VARCHAR AS line, false AS over FROM l
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN head OR over THEN sec + 1 ELSE sec END,
    CASE WHEN head THEN length(x) ELSE m + length(x) END, CASE WHEN head THEN x ELSE title END, x, NOT head AND m + length(x) > 3000
  FROM (SELECT *, CASE WHEN over THEN 0 ELSE n END AS m, regexp_matches(x, '(?i)^(第[一二三四五六七八九十百千0-9]+[章节部篇]|chapter\\s+[0-9]+)') OR (length(x) < 50 AND x <> '' AND NOT regexp_matches(x, '[。！？.!?，,]$')) AS head
    FROM (SELECT *, s[i + 1] AS x FROM b WHERE i < len(s)))),
g AS (SELECT doc_id, sec, coalesce(max(title), '{C.NO_TITLE}') AS title, bool_or(over) AS over, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> '') AS content FROM b WHERE i > 0 GROUP BY doc_id, sec),
found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_index, title, content FROM g WHERE over OR length(content) > 100)
SELECT *, {_OUT} FROM (SELECT * FROM found UNION ALL SELECT * FROM general WHERE doc_id NOT IN (SELECT doc_id FROM found))"""

_KIND = "CASE WHEN len(list_filter(list_slice(string_split(text, chr(10)), 1, 10), lambda x: contains(x, ',') AND NOT starts_with(x, '#'))) > 0 THEN 'csv' WHEN len(list_filter(list_slice(string_split(text, chr(10)), 1, 10), lambda x: contains(x, '|'))) > 0 THEN 'markdown' ELSE 'general' END"
_ASK = f"list_slice(list_concat(list_transform(list_slice(list_filter(list_transform(regexp_split_to_array({{0}}, '[。！？.!?]'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 10), 1, {{1}}), lambda s: CASE WHEN contains(s, '是') OR contains(s, '为') THEN '关于这段内容，' || substring(s, 1, 20) || '...的具体情况是什么？' WHEN contains(s, '如何') OR contains(s, '怎么') THEN substring(s, 1, 30) || '...？' ELSE '这段内容中提到的' || substring(s, 1, 15) || '...是什么意思？' END), list_transform(range({{1}}), lambda x: '{C.DEFAULT_QUESTION}')), 1, {{1}})"
SQL = {
    "chunk_naive": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s::VARCHAR AS title, substring(text, s + 1, 500) AS content, length(substring(text, s + 1, 500)) // 4 AS token_count, sha256(substring(text, s + 1, 500)) AS content_hash FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 450)) AS s FROM {_D})",
    "chunk_general": f"WITH RECURSIVE {_GENERAL} SELECT *, {_OUT} FROM general",
    "chunk_book": _BOOK,
    "chunk_paper": _sectioned(C.PAPER, 100, 50),
    "chunk_resume": _sectioned(C.RESUME, 50, 20),
    "chunk_dispatch_stats": f"SELECT {_KIND} AS kind, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM {_D} GROUP BY 1",
    "chunk_table_csv": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM {_D} WHERE {_KIND} = 'csv'),
r AS (SELECT doc_id, list_transform(string_split({_STRIP.format('s[1]')}, ','), lambda x: {_STRIP.format('x')}) AS h, unnest(range(0, len(s))) AS row, {_STRIP.format('unnest(s)')} AS line FROM d),
v AS (SELECT doc_id, row, h, list_concat(list_transform(string_split(line, ','), lambda x: {_STRIP.format('x')}), list_transform(range(len(h)), lambda x: '')) AS v FROM r WHERE row > 0 AND line <> '')
SELECT doc_id, row, array_to_string(list_transform(range(1, len(h) + 1), lambda k: h[k] || ': ' || v[k]), chr(10)) AS content FROM v""",
    "chunk_keywords": """
WITH w AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[一-龥]{2,}') AS x FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank, word, n FROM c QUALIFY rank <= 5""",
    "chunk_questions": f"SELECT doc_id, unnest(range(1, 4)) AS n, unnest({_ASK.format('text', 3)}) AS question FROM documents WHERE text IS NOT NULL",
    "chunk_enrich": f"SELECT DISTINCT id, length(content) // 4 AS token_count, sha256(content) AS content_hash, content_hash IS NOT DISTINCT FROM sha256(content) AS hash_fresh, token_count IS NOT DISTINCT FROM length(content) // 4 AS count_right, {_ASK.format('content', 1)}[1] AS question FROM (SELECT id, content, content_hash, token_count FROM knowledge_chunk) k WHERE content IS NOT NULL",
    "chunk_dedup_hash": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
SQL["chunk_enrich"] = SQL["chunk_enrich"].replace("content_hash IS NOT DISTINCT", "k.content_hash IS NOT DISTINCT").replace("token_count IS NOT DISTINCT", "k.token_count IS NOT DISTINCT")
