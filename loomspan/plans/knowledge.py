"""Queries over chunks, retrieval, evaluation and snapshots, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_ref
from ..operators import chunk_table as K
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.snapshots_diff import delivery_number
from ..sources.shared import materialize
from ..sources.tables import read_table as t

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
_CUR = f"""cur AS (SELECT * REPLACE ({_REF.format('file_id')} AS file_id) FROM knowledge_chunk QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC, chunk_index DESC, {_REF.format('file_id')}) = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id, file_id ORDER BY chunk_index, id) - 1 AS pos FROM cur)"""


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return K.numbered(K.current_chunks(t(spark, folder, "knowledge_chunk")))


@query(f"WITH {_CUR} SELECT knowledge_id, file_id, pos, id, chunk_index, length(content) AS n_chars FROM num")
def chunks_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(spark, folder).select("knowledge_id", "file_id", "pos", "id", "chunk_index", F.length("content").cast("bigint").alias("n_chars"))


@query(f"WITH {_CUR} SELECT id, knowledge_id, file_id, content, updated_at FROM cur")
def chunk_detail(spark: SparkSession, folder: str) -> DataFrame:
    return K.current_chunks(t(spark, folder, "knowledge_chunk")).select("id", "knowledge_id", "file_id", "content", "updated_at")


@query(f"""WITH {_CUR}, s AS (SELECT *, count(*) OVER (PARTITION BY knowledge_id, file_id) AS n FROM num)
SELECT id, knowledge_id, file_id, CASE WHEN n > 1 AND pos > 1 THEN pos - 1 ELSE pos END AS pos, content, meta FROM s WHERE NOT (n > 1 AND pos BETWEEN 0 AND 1)
UNION ALL SELECT sha256(min_by(id, pos) || '|merged'), knowledge_id, file_id, 0, string_agg(content, chr(10) || chr(10) ORDER BY pos), first(meta ORDER BY pos) FROM s WHERE n > 1 AND pos <= 1 GROUP BY knowledge_id, file_id""")
def chunk_merge(spark: SparkSession, folder: str) -> DataFrame:
    return K.merge_range(_numbered(spark, folder), 0, 1)


@query(f"""WITH {_CUR}, h AS (SELECT *, length(content) // 2 AS half FROM num),
x AS (SELECT *, regexp_replace(substring(content, 1, half), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS a, regexp_replace(substring(content, half + 1), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS b FROM h),
c AS (SELECT *, pos = 0 AND half > 0 AND a <> '' AND b <> '' AS cut FROM x),
m AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY knowledge_id, file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM c)
SELECT id, knowledge_id, file_id, (pos + earlier)::BIGINT AS pos, CASE WHEN cut THEN a ELSE content END AS content, meta FROM m
UNION ALL SELECT sha256(id || '|split'), knowledge_id, file_id, (pos + earlier + 1)::BIGINT, b, meta FROM m WHERE cut""")
def chunk_split(spark: SparkSession, folder: str) -> DataFrame:
    return K.split_chunk(_numbered(spark, folder), F.floor(F.length("content") / 2).cast("int"), F.col("pos") == 0)


@query(f"""WITH {_CUR}, f AS (SELECT DISTINCT knowledge_id, file_id FROM num WHERE pos = 0 AND length(content) > 1000)
SELECT id, knowledge_id, file_id, pos, content FROM num ANTI JOIN f USING (knowledge_id, file_id)
UNION ALL SELECT id, knowledge_id, file_id, pos, '# ' || content FROM num SEMI JOIN f USING (knowledge_id, file_id)""")
def chunk_persist_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose first chunk is long are delivered anew (with a mark) and replace what was there."""
    rows = _numbered(spark, folder).select("id", "knowledge_id", "file_id", "pos", "content")
    files = rows.where((F.col("pos") == 0) & (F.length("content") > 1000)).select("knowledge_id", "file_id").distinct()
    new = rows.join(files, ["knowledge_id", "file_id"], "left_semi").withColumn("content", F.concat(F.lit("# "), F.col("content")))
    return K.replace_file_chunks(rows, new)


@query(f"""WITH {_CUR}, k AS (SELECT id, file_id, chunk_index, content, CASE WHEN json_valid(meta) THEN json_keys(meta) ELSE [] END AS k FROM cur)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(k, ['file_id', 'chunk_index', 'content_hash']))), ',') AS keys, file_id, chunk_index::VARCHAR AS chunk_index, sha256(content) AS content_hash FROM k""")
def chunk_reindex_meta(spark: SparkSession, folder: str) -> DataFrame:
    m = K.reindex_meta(K.current_chunks(t(spark, folder, "knowledge_chunk")))
    return m.select("id", F.array_join(F.array_sort(F.map_keys("meta_map")), ",").alias("keys"), F.col("meta_map")["file_id"].alias("file_id"), F.col("meta_map")["chunk_index"].alias("chunk_index"), F.col("meta_map")["content_hash"].alias("content_hash"))


_TOPK = """WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id {})
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p QUALIFY rank <= 10"""


@query(_TOPK.format(""))
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    items = t(spark, folder, "embeddings")
    return R.vector_topk(items, items.where(F.col("vec_id") % 20 == 0))


@query(_TOPK.format("AND q.label = i.label"))
def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    items = t(spark, folder, "embeddings")
    return R.vector_topk(items, items.where(F.col("vec_id") % 20 == 0), same_group=True)


def _context(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "golden_set").select("id", "kb_id", "question", F.posexplode("context_chunks").alias("pos", "c")).withColumn("pos", F.col("pos").cast("bigint"))


_CTX = "ctx AS (SELECT id, kb_id, question, unnest(range(0, len(context_chunks))) AS pos, unnest(context_chunks) AS c FROM golden_set)"


@query(f"WITH {_CTX} SELECT id, 'result-' || pos || '-' || substring(sha256(c.text), 1, 8) AS chunk_id, substring(c.text, 1, 500) AS text, c.score AS score, pos + 1 AS rank FROM ctx WHERE c.text IS NOT NULL")
def retrieval_results_shaped(spark: SparkSession, folder: str) -> DataFrame:
    rows = _context(spark, folder).where("c.text IS NOT NULL")
    return rows.select("id", R.result_id(F.col("pos"), F.col("c.text")).alias("chunk_id"), F.substring("c.text", 1, 500).alias("text"), F.col("c.score").alias("score"), (F.col("pos") + 1).alias("rank"))


_BM25 = f"""WITH {_CUR},
w AS (SELECT knowledge_id AS scope, id AS item_id, regexp_extract_all(lower(content), '[\\pL\\pN]+') AS w FROM cur),
tf AS (SELECT scope, item_id, len, word, count(*) AS tf FROM (SELECT scope, item_id, len(w) AS len, unnest(w) AS word FROM w) GROUP BY ALL),
size AS (SELECT scope, count(*) AS n, avg(len(w)) AS avg_len FROM w GROUP BY 1),
df AS (SELECT scope, word, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT kb_id AS scope, id AS query_id, unnest(regexp_extract_all(lower(question), '[\\pL\\pN]+')) AS word FROM golden_set WHERE kb_id IS NOT NULL),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM q JOIN df USING (scope, word) JOIN size USING (scope) JOIN tf USING (scope, word) GROUP BY ALL)"""


def _bm25(spark: SparkSession, folder: str, k: int) -> DataFrame:
    items = K.current_chunks(t(spark, folder, "knowledge_chunk")).select(F.col("knowledge_id").alias("scope"), F.col("id").alias("item_id"), F.col("content").alias("text"))
    asked = t(spark, folder, "golden_set").where("kb_id IS NOT NULL").select(F.col("kb_id").alias("scope"), F.col("id").alias("query_id"), F.col("question").alias("text"))
    return R.bm25_topk(items, asked, k)


@query(_BM25 + " SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, 10)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = "[" + ", ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(0).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        counts = np.zeros((len(text), len(_LETTERS)))
        for i in range(len(text)):
            counts[i] = np.bincount(data[ends[i] : ends[i + 1]], minlength=256)[97:123]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * len(_LETTERS), pa.int32()), pa.array(counts.ravel()), mask=text.is_null())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], vectors], names=[*batch.schema.names[1:], "embedding"])


def _letter_vectors(df: DataFrame, text: str) -> DataFrame:
    """Counts of the letters a to z of ``text`` in its place, as a small vector that both engines can make; NULL without a text."""
    rest = [c for c in df.columns if c != text]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(F.lower(text), *rest).mapInArrow(_letter_counts, f"{kinds}, embedding array<double>")


@query(_BM25 + f""", wa AS (SELECT query_id, ('0x' || substr(item_id, 1, 8))::BIGINT AS item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 50),
iv AS (SELECT ('0x' || substr(id, 1, 8))::BIGINT AS id, knowledge_id AS scope, {_COUNTS.format('content')} AS v FROM cur WHERE content IS NOT NULL), qv AS (SELECT id AS query_id, kb_id AS scope, {_COUNTS.format('question')} AS v FROM golden_set WHERE kb_id IS NOT NULL),
vb AS (SELECT query_id, iv.id AS item_id, round(coalesce(CASE WHEN list_sum(iv.v) > 0 AND list_sum(qv.v) > 0 THEN list_cosine_similarity(iv.v, qv.v) END, 0), 6) AS score FROM qv JOIN iv USING (scope) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 50),
sa AS (SELECT query_id, item_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS x FROM wa),
sb AS (SELECT query_id, item_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS y FROM vb),
f AS (SELECT query_id, item_id, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 6) AS score FROM sa FULL JOIN sb USING (query_id, item_id))
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f WHERE score >= 0.2 QUALIFY rank <= 10""")
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 and a vector ranking of the same chunks for the same questions, 50 of each, fused at equal weight with a threshold."""
    number = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")
    words = _bm25(spark, folder, 50).withColumn("item_id", number("item_id"))
    chunks = t(spark, folder, "knowledge_chunk").select("id", "knowledge_id", "file_id", "chunk_index", "content", "created_at", "updated_at")
    chunks = K.current_chunks(_letter_vectors(chunks, "content")).where("embedding IS NOT NULL").select(F.col("knowledge_id").alias("scope"), number("id").alias("item_id"), "embedding")
    asked = t(spark, folder, "golden_set").where("kb_id IS NOT NULL").select(F.col("kb_id").alias("scope"), F.col("id").alias("query_id"), "question")
    asked = _letter_vectors(asked, "question")
    near = R.scoped_topk(chunks, asked, 50)
    return R.hybrid_topk(words, near, 0.5, 0.2)


@query(f"""WITH {_CTX}, f AS (SELECT id, pos, c.text AS text, coalesce(c.source, 'N/A') AS source, min(pos) OVER (PARTITION BY id, coalesce(c.source, 'N/A')) AS first FROM ctx WHERE c.text IS NOT NULL),
d AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY first) AS number FROM f)
SELECT id, string_agg('<source id="' || number || '" name="' || source || '">' || text || '</source>', chr(10) ORDER BY pos) AS context, count(DISTINCT number) AS n_sources FROM d GROUP BY id""")
def source_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = _context(spark, folder).where("c.text IS NOT NULL").select("id", "pos", F.col("c.text").alias("text"), F.coalesce("c.source", F.lit("N/A")).alias("source"))
    rows = R.source_numbers(rows, "id", "pos", "source")
    line = F.concat(F.lit('<source id="'), F.col("number"), F.lit('" name="'), F.col("source"), F.lit('">'), F.col("text"), F.lit("</source>"))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("context"), F.count_distinct("number").alias("n_sources"))


@query(f"WITH {_CTX} SELECT id, coalesce(c.source, 'N/A') AS source, count(*) AS n_texts, min(pos) AS first_pos, max(c.score) AS best_score FROM ctx GROUP BY ALL")
def citation_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = _context(spark, folder)
    return rows.groupBy("id", F.coalesce("c.source", F.lit("N/A")).alias("source")).agg(F.count(F.lit(1)).alias("n_texts"), F.min("pos").alias("first_pos"), F.max("c.score").alias("best_score"))


@query(f"WITH {_CTX} SELECT kb_id, count(DISTINCT c.source) AS n_sources, count(*) AS n_texts FROM ctx GROUP BY 1")
def distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder).groupBy("kb_id").agg(F.count_distinct("c.source").alias("n_sources"), F.count(F.lit(1)).alias("n_texts"))


_JUDGED = f"j AS (SELECT DISTINCT knowledge_id, query_text, {_REF.format('chunk_id')} AS chunk_id FROM knowledge_relevance_judgment)"


@query(f"""WITH {_CUR}, {_JUDGED},
h AS (SELECT j.knowledge_id, j.query_text, coalesce(cur.file_id, '') AS file_id, cur.chunk_index, cur.id, cur.content FROM j JOIN cur ON cur.id = j.chunk_id WHERE cur.content <> '')
SELECT knowledge_id, query_text, file_id, count(*) AS n_chunks, left(chr(10) || string_agg(content, chr(10) ORDER BY chunk_index, id), 8000) AS body FROM h GROUP BY ALL""")
def retriever_step(spark: SparkSession, folder: str) -> DataFrame:
    """The judged chunks of each query, by file and in order, as the text a step gets (8,000 characters a file)."""
    judged = t(spark, folder, "knowledge_relevance_judgment").select("knowledge_id", "query_text", norm_ref(F.col("chunk_id")).alias("id")).distinct()
    chunks = K.current_chunks(t(spark, folder, "knowledge_chunk")).where("content != ''").select("id", "file_id", "chunk_index", "content")
    rows = judged.join(chunks, "id").groupBy("knowledge_id", "query_text", F.coalesce("file_id", F.lit("")).alias("file_id"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content")))
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.substring(F.concat(F.lit("\n"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n")), 1, 8000).alias("body"))


_TEMPLATE = "Use this:\n{{CONTEXT}}\nto answer: {{QUERY}}"


@query(f"""WITH {_CTX}, x AS (SELECT id, any_value(question) AS question, string_agg(c.text, chr(10) ORDER BY pos) AS context FROM ctx WHERE c.text IS NOT NULL GROUP BY id)
SELECT id, replace(replace('Use this:' || chr(10) || '{{{{CONTEXT}}}}' || chr(10) || 'to answer: {{{{QUERY}}}}', '{{{{CONTEXT}}}}', context), '{{{{QUERY}}}}', question) AS prompt FROM x""")
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = _context(spark, folder).where("c.text IS NOT NULL").groupBy("id").agg(F.any_value("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("c.text").alias("text")))), lambda x: x["text"]), "\n").alias("context"))
    return rows.select("id", F.replace(F.replace(F.lit(_TEMPLATE), F.lit("{{CONTEXT}}"), F.col("context")), F.lit("{{QUERY}}"), F.col("question")).alias("prompt"))


@query("SELECT DISTINCT id, CASE WHEN json_valid(s) THEN s->>'method' END AS method FROM (SELECT id, nullif(regexp_extract('Sure: ' || meta || ' .', '(\\{.*\\})', 1, 's'), '') AS s FROM knowledge_chunk WHERE meta IS NOT NULL)")
def query_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "knowledge_chunk").where("meta IS NOT NULL")
    sliced = R.json_slice(F.concat(F.lit("Sure: "), F.col("meta"), F.lit(" .")))
    return rows.select("id", F.from_json(sliced, "map<string,string>")["method"].alias("method")).distinct()


@query("""WITH m AS (SELECT knowledge_id, query_text, count(DISTINCT CASE WHEN relevance = 1 THEN coalesce(chunk_id, '∅') END) AS n_relevant, count(DISTINCT CASE WHEN relevance = 1 AND rank_position BETWEEN 1 AND 10 THEN chunk_id END) AS hit,
  max(CASE WHEN relevance = 1 AND rank_position > 0 THEN 1.0::DOUBLE / rank_position END) AS best FROM knowledge_relevance_judgment GROUP BY ALL)
SELECT knowledge_id, query_text, n_relevant, round(hit / n_relevant, 4) AS recall, round(hit / 10, 4) AS precision, round(coalesce(best, 0), 4) AS mrr FROM m WHERE n_relevant > 0""")
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.retrieval_metrics(t(spark, folder, "knowledge_relevance_judgment"))


@query("SELECT id, knowledge_id, query_text, chunk_id, relevance FROM knowledge_relevance_judgment QUALIFY row_number() OVER (PARTITION BY knowledge_id, query_text, chunk_id ORDER BY created_at DESC, id DESC) = 1")
def annotate_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return E.upsert_judgments(t(spark, folder, "knowledge_relevance_judgment")).select("id", "knowledge_id", "query_text", "chunk_id", "relevance")


@query("SELECT knowledge_id, query_text, count(*) AS n_judgments, count(*) FILTER (WHERE relevance = 1) AS n_relevant, max(created_at) AS last_at FROM (SELECT DISTINCT * FROM knowledge_relevance_judgment) GROUP BY ALL")
def judgments_by_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "knowledge_relevance_judgment").distinct()
    return rows.groupBy("knowledge_id", "query_text").agg(F.count(F.lit(1)).alias("n_judgments"), F.count_if(F.col("relevance") == 1).alias("n_relevant"), F.max("created_at").alias("last_at"))


@query("""WITH hot AS (SELECT query_text FROM knowledge_relevance_judgment GROUP BY 1 ORDER BY count(*) DESC, query_text LIMIT 1)
SELECT DISTINCT id, knowledge_id FROM knowledge_relevance_judgment WHERE query_text NOT IN (SELECT query_text FROM hot)""")
def judgments_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What is left when the most frequent query's judgments are deleted."""
    rows = t(spark, folder, "knowledge_relevance_judgment")
    hot = rows.groupBy("query_text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query_text").limit(1)
    return rows.join(hot, "query_text", "left_anti").select("id", "knowledge_id").distinct()


_FAITH = "CASE WHEN answer IS NULL OR regexp_full_match(answer, '[\\s\\pZ]*') THEN 0.0 WHEN coalesce(len(claims), 0) = 0 THEN 1.0 ELSE round(len(list_filter(claims, lambda c: c.supported = 'yes')) / len(claims), 4) END"


@query(f"SELECT DISTINCT result_id, {_FAITH}::DOUBLE AS faithfulness, coalesce(len(claims), 0) AS n_claims FROM eval_result")
def faithfulness_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "eval_result")
    return rows.select("result_id", E.faithfulness(F.col("answer"), F.col("claims")).alias("faithfulness"), F.coalesce(F.size("claims"), F.lit(0)).cast("bigint").alias("n_claims")).distinct()


@query(f"SELECT count(*) AS n_items, coalesce(round(avg(f), 4), 0) AS mean_faithfulness, coalesce(round(avg(f), 4), 0) >= 0.8 AS passed FROM (SELECT DISTINCT result_id, {_FAITH}::DOUBLE AS f, coalesce(len(claims), 0) FROM eval_result)")
def faithfulness_gate(spark: SparkSession, folder: str) -> DataFrame:
    return E.gate(faithfulness_items(spark, folder))


@query("SELECT printf('q%03d', row_number() OVER (ORDER BY id)) AS new_id, id, question, golden_answer FROM golden_set")
def golden_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Skeleton ids q001, q002, ... in order, numbered by offsets of partitions instead of in one task."""
    rows = t(spark, folder, "golden_set").select("id", "question", "golden_answer")
    placed = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("_p", F.spark_partition_id())
    placed = materialize(placed)
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()  # one row a partition
    before, total = {}, 0
    for r in sizes:
        before[r["_p"]], total = total, total + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p")) if before else F.lit(0)
    n = F.row_number().over(W.partitionBy("_p").orderBy("id")) + offset
    return placed.select(F.format_string("q%03d", n).alias("new_id"), "id", "question", "golden_answer")


@query("SELECT DISTINCT result_id, result_id || ' ' || printf('%.4f', faithfulness) || ' ' || CASE WHEN refusal THEN 'refusal' ELSE coalesce(len(claims), 0) || ' claims' END AS line FROM eval_result WHERE faithfulness IS NOT NULL")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "eval_result").where("faithfulness IS NOT NULL")
    what = F.when(F.col("refusal"), "refusal").otherwise(F.concat(F.coalesce(F.size("claims"), F.lit(0)), F.lit(" claims")))
    return rows.select("result_id", F.concat_ws(" ", "result_id", F.format_string("%.4f", F.col("faithfulness")), what).alias("line")).distinct()


@query(f"""WITH {_CUR}, f AS (SELECT knowledge_id, count(DISTINCT file_id) AS file_count, count(*) AS chunk_count, sha256(string_agg(id || ':' || coalesce(content_hash, ''), ',' ORDER BY id)) AS digest FROM cur GROUP BY 1) SELECT * FROM f""")
def snapshot_create_counts(spark: SparkSession, folder: str) -> DataFrame:
    cur = K.current_chunks(t(spark, folder, "knowledge_chunk"))
    parts = F.array_sort(F.collect_list(F.concat(F.col("id"), F.lit(":"), F.coalesce("content_hash", F.lit("")))))
    return cur.groupBy("knowledge_id").agg(F.count_distinct("file_id").alias("file_count"), F.count(F.lit(1)).alias("chunk_count"), F.sha2(F.array_join(parts, ","), 256).alias("digest"))


_SNAP = "files array<struct<file_id:string,filename:string,directory_id:string>>, chunks array<struct<id:string,file_id:string,content_hash:string>>, _bad string"


def _ends(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last complete delivery of each knowledge base by time."""
    doc = F.from_json("snapshot_data", _SNAP, {"columnNameOfCorruptRecord": "_bad"})
    rows = t(spark, folder, "knowledge_snapshot").select("knowledge_id", "id", "created_at", doc.alias("d")).where("d IS NOT NULL AND d._bad IS NULL")
    return K.latest(rows, ["knowledge_id"], [F.col("created_at"), F.col("id")]), K.latest(rows, ["knowledge_id"], [F.desc("created_at"), F.desc("id")])


_ENDS = """s AS (SELECT knowledge_id, id, created_at, from_json(snapshot_data, '{"files":[{"file_id":"VARCHAR","filename":"VARCHAR","directory_id":"VARCHAR"}],"chunks":[{"id":"VARCHAR","file_id":"VARCHAR","content_hash":"VARCHAR"}]}') AS d FROM knowledge_snapshot WHERE json_valid(snapshot_data)),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at, id) = 1), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id DESC) = 1),
fa AS (SELECT DISTINCT knowledge_id, f.file_id, f.filename FROM (SELECT knowledge_id, unnest(d.files) AS f FROM a)), fb AS (SELECT DISTINCT knowledge_id, f.file_id, f.filename FROM (SELECT knowledge_id, unnest(d.files) AS f FROM b))"""


def _files(df: DataFrame) -> DataFrame:
    return df.select("knowledge_id", F.explode("d.files").alias("f")).select("knowledge_id", "f.file_id", "f.filename").distinct()


@query(f"WITH {_ENDS} SELECT * FROM fb EXCEPT SELECT * FROM fa")
def snapshot_added(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _ends(spark, folder)
    return _files(b).subtract(_files(a))


@query(f"WITH {_ENDS} SELECT * FROM fa EXCEPT SELECT * FROM fb")
def snapshot_removed(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _ends(spark, folder)
    return _files(a).subtract(_files(b))


@query(f"""WITH {_ENDS}, ha AS (SELECT knowledge_id, c.file_id AS file_id, list_sort(list(DISTINCT coalesce(c.content_hash, '∅'))) AS h FROM (SELECT knowledge_id, unnest(d.chunks) AS c FROM a) GROUP BY ALL),
hb AS (SELECT knowledge_id, c.file_id AS file_id, list_sort(list(DISTINCT coalesce(c.content_hash, '∅'))) AS h FROM (SELECT knowledge_id, unnest(d.chunks) AS c FROM b) GROUP BY ALL)
SELECT ha.knowledge_id, ha.file_id FROM ha JOIN hb USING (knowledge_id, file_id) WHERE ha.h <> hb.h""")
def snapshot_modified(spark: SparkSession, folder: str) -> DataFrame:
    def hashes(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("knowledge_id", F.explode("d.chunks").alias("c"))
        return rows.groupBy("knowledge_id", F.col("c.file_id").alias("file_id")).agg(F.array_sort(F.collect_set(F.coalesce("c.content_hash", F.lit("∅")))).alias(name))

    a, b = _ends(spark, folder)
    return hashes(a, "x").join(hashes(b, "y"), ["knowledge_id", "file_id"]).where("x != y").select("knowledge_id", "file_id")


@query("""WITH s AS (SELECT id, from_json(snapshot_data, '{"files":[{"file_id":"VARCHAR","filename":"VARCHAR","directory_id":"VARCHAR"}]}').files AS f FROM knowledge_snapshot WHERE json_valid(snapshot_data)),
x AS (SELECT id, unnest(range(0, len(f))) AS pos, unnest(f) AS f FROM s)
SELECT DISTINCT id, f.file_id AS file_id, f.filename AS filename, pos FROM x WHERE f.file_id IS NOT NULL QUALIFY rank() OVER (PARTITION BY id, f.file_id ORDER BY pos) = 1""")
def snapshot_rollback_files(spark: SparkSession, folder: str) -> DataFrame:
    """The links each snapshot restores: the first entry of each file."""
    doc = F.from_json("snapshot_data", _SNAP, {"columnNameOfCorruptRecord": "_bad"})
    rows = t(spark, folder, "knowledge_snapshot").select("id", doc.alias("d")).where("d IS NOT NULL AND d._bad IS NULL").select("id", F.posexplode("d.files").alias("pos", "f")).where("f.file_id IS NOT NULL")
    first = rows.groupBy("id", F.col("f.file_id").alias("file_id")).agg(F.min(F.struct("pos", F.col("f.filename").alias("filename"))).alias("m"))
    return first.select("id", "file_id", F.col("m.filename").alias("filename"), F.col("m.pos").cast("bigint").alias("pos"))


@query("SELECT DISTINCT knowledge_id, id, label, TRY_CAST(nullif(regexp_extract(translate(label, '０１２３４５６７８９', '0123456789'), '([0-9]+)', 1), '') AS BIGINT) AS number, created_at, dense_rank() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id) AS place FROM knowledge_snapshot")
def snapshots_list(spark: SparkSession, folder: str) -> DataFrame:
    place = F.dense_rank().over(W.partitionBy("knowledge_id").orderBy(F.desc("created_at"), "id")).cast("bigint")
    return t(spark, folder, "knowledge_snapshot").select("knowledge_id", "id", "label", delivery_number(F.col("label")).cast("bigint").alias("number"), "created_at", place.alias("place")).distinct()
